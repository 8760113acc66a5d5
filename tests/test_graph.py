import random

import pytest

from foliant.operators.graph import connected_components, linked_groups
from foliant.operators.scratch import Scratch


@pytest.fixture
def scratch(spark):
    s = Scratch(spark, "graph")
    yield s
    s.drop()


def test_random_graphs(spark, scratch):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 460)] + [(1, 1), (None, 3), (5, None)]
    up = {}

    def find(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    want = {k: find(k) for k in up if find(k) != k}
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.id: r.component for r in connected_components(df, scratch).collect()} == want
    assert connected_components(df.limit(0), scratch, "none").count() == 0


def test_a_long_chain(spark, scratch):
    df = spark.range(500).selectExpr("id as a", "id + 1 as b")
    got = connected_components(df, scratch, "chain").collect()
    assert len(got) == 500 and {r.component for r in got} == {0}


def test_linked_groups_against_brute_force(spark):
    rnd = random.Random(3)
    labels = {k: {f"l{rnd.randrange(40)}" for _ in range(rnd.randint(0, 4))} for k in range(150)}
    up = list(range(150))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in labels:
        for b in range(a):
            if len(labels[a] & labels[b]) >= 2:
                up[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(k, x) for k, ls in labels.items() for x in ls] + [(1, None), (None, "l1")], "key bigint, label string")
    assert {r.key: r.group_id for r in linked_groups(df, "key", "label").collect()} == {k: find(k) for k, ls in labels.items() if ls}
