"""Every registered query runs, and agrees with its SQL where it has one."""

import pytest

import foliant.plans  # noqa: F401
from foliant.registry import QUERIES, SQL
from tests.compare import SMALL, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(df, SQL[name])
    else:
        assert df.columns
        df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert {"doc_id", "chunk_id"} <= set(df.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
