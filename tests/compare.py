"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def oracle(sql: str, sf_dir: str = SMALL):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(df, sql: str, sf_dir: str = SMALL):
    columns = sorted(df.columns)
    names, rows = oracle(sql, sf_dir)
    assert sorted(names) == columns
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rows)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert got == want
