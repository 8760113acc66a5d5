import gzip
import io

import pytest
from pyspark.sql import functions as F

from foliant.llm import warc


def records(spark, rows):
    return spark.createDataFrame(rows, "record_no bigint, uri string, payload binary, record_type string")


def run(spark, scratch, rows):
    df = records(spark, [(*r, "x") for r in rows])
    made, back = warc.dedupe_archives(df, scratch)
    return made, sorted((r.asDict() for r in back.collect()), key=lambda r: (r["record_no"] is None, r["record_no"] or 0, r["uri"] or "", r["payload_digest"]))


def test_revisits_and_edge_cases(spark, scratch):
    big, small = b"x" * 1000, b"y" * 999
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (3, None, big), (4, "u4", small), (5, "u5", small), (6, "http://a/\r\nX: y", None), (None, "n", big), (7, "", b"")]
    made, got = run(spark, scratch, rows)
    assert made.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    kinds = [(r["record_no"], r["record_type"], r["refers_to"]) for r in got]
    assert kinds == [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (None, "revisit", 3)]
    assert {r["payload_bytes"] for r in got} == {0, 999, 1000}
    # A revisit cites the record id of its response.
    ids = {r["record_no"]: r["warc_record_id"] for r in got}
    assert got[0]["warc_refers_to"] == ids[3]


def test_payload_survives(spark, scratch):
    payload = "é\r\n\r\nWARC/1.1\r\n".encode() * 200
    made, _ = warc.dedupe_archives(records(spark, [(1, "u", payload, "x")]), scratch)
    path = made.first().path
    back = warc.read_archives(spark.createDataFrame([(path,)], "path string"), with_payload=True).first()
    assert bytes(back.payload) == payload
    with open(path, "rb") as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_plain_and_broken_archives():
    record = warc.encode_record(1, "u", "00" * 20, 3, "response", None, None, b"abc")
    assert [b[-3:] for _, b in warc.parse_records(io.BytesIO(record * 2))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(record[:-8])))


def test_groups_beyond_those_that_are_broadcast(spark, scratch):
    rows = [(10 * g + k, f"u{k}", bytes([65 + g]) * (1000 + g)) for g in range(6) for k in range(g + 1)]
    df = records(spark, [(*r, "x") for r in rows])
    got = {r.record_no: (r.record_type, r.refers_to, r.payload is None) for r in warc.resolve_revisits(df, scratch, broadcast_groups=2).collect()}
    top = {g: 10 * g + g for g in range(6)}
    assert got == {n: ("response", None, False) if n == top[n // 10] else ("revisit", top[n // 10], True) for n, _, _ in rows}


def test_files_of_other_attempts_go(spark, scratch):
    import os

    folder = scratch.path("strays").removeprefix("file://")
    os.makedirs(folder)
    for name in ("part-00000-0000-99.warc.gz", "part-00000-0001-99.warc.gz.tmp"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(gzip.compress(b"WARC/1.1\r\n"))
    made, back = warc.dedupe_archives(records(spark, [(1, "u", b"a" * (3 << 20), "x")]), scratch, scratch.path("strays"))
    assert back.count() == 1 and sorted(f for f in os.listdir(folder) if not f.startswith(".")) == [made.first().path.rpartition("/")[2]]


def test_empty(spark, scratch):
    _, got = run(spark, scratch, [])
    assert got == []
