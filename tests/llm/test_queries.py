"""The queries of the subpackage over the smallest tables, against SQL where there is any."""

import pytest

from foliant.llm.queries import QUERIES, SQL
from tests.compare import SMALL, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, SMALL), SQL[name])


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
