import numpy as np
import pytest

from foliant.llm import rp_forest as R


def brute(rows):
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    def ok(r):
        return r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return sorted(((r[0], links[k], low.get(find(k)), r[0] is not None and r[0] == low[find(k)]) for k, r in enumerate(rows)), key=str)


def run(spark, scratch, rows):
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id bigint, embedding array<float>, label int, cid int")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in R.near_duplicates(df, scratch).collect()), key=str)


@pytest.mark.parametrize("leaf_rows", [1024, 40])
def test_against_brute_force(spark, scratch, leaf_rows, monkeypatch):
    monkeypatch.setattr(R, "LEAF_ROWS", leaf_rows)
    rng = np.random.default_rng(leaf_rows)
    rows, k = [], 0
    for _ in range(40):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 14)):
            x = (centre + rng.standard_normal(16) * 0.14).astype(np.float32)
            rows.append((k, [float(v) for v in x], int(rng.integers(0, 2))))
            k += 1
    for r in rows[:5]:
        rows += [(k, r[1], r[2]), (k + 1, r[1], r[2])]
        k += 2
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 0.0], 0), ([0.0, 0.0], 0), (None, 0), ([nan, 1.0], 0), ([inf, 1.0], 0), ([None, 1.0], 0), ([1.0, 0.0], None), ([], 0), ([1.0, 0.0], 0), ([2.0, 0.0], 0), ([1e30, 0.0], 0)]
    rows += [(1000 + n, *o[-2:]) if len(o) == 2 else o for n, o in enumerate(odd)]
    assert run(spark, scratch, rows) == brute(rows)


def test_large_and_small_values_and_many_lengths(spark, scratch, monkeypatch):
    monkeypatch.setattr(R, "FEW", 3)
    rows = [(0, [1e200, 2e200, 3e200], 0), (1, [1e200, 2e200, 3.0001e200], 0), (2, [1e-200, 2e-200, 3e-200], 0), (3, [-1e200, 2e200, 3e200], 0), (4, [5e-324, 0.0, 0.0], 0)]
    rows += [(100 + 2 * d + k, [1.0] * d + [0.001 * k], 1) for d in range(4, 80) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in R.near_duplicates(df, scratch).collect()}
    assert [got[k] for k in range(5)] == [(2, 0), (2, 0), (2, 0), (0, 3), (0, 4)]
    assert all(got[100 + 2 * d + k] == (1, 100 + 2 * d) for d in range(4, 80) for k in range(2))


def test_leaves_follow_the_size_of_the_label():
    rng = np.random.default_rng(4)
    x = R.unit(rng.standard_normal((3000, 16)))
    forest = R.fit(x[:1000], 5)
    depth = np.where(np.arange(3000) < 500, 0, np.where(np.arange(3000) < 1500, 2, 9))
    row, leaf = forest.leaves(x, depth)
    node = leaf % 2**6
    assert set(np.bincount(row[row < 500])[:500].tolist()) == {R.TREES}
    level = np.floor(np.log2(node + 1)).astype(int)
    assert (level == np.minimum(depth[row], 5)).all()


def test_empty_and_single(spark, scratch):
    assert run(spark, scratch, []) == []
    assert run(spark, scratch, [(3, [1.0, 2.0], 0)]) == [(3, 0, 3, True)]


def test_recall_of_the_forest_alone():
    rng = np.random.default_rng(8)
    x = R.unit(rng.standard_normal((4000, 64)))
    y = R.unit(x[:1000] + R.unit(rng.standard_normal((1000, 64))) * 0.195)
    both = np.concatenate([x, y])
    forest = R.fit(both[rng.permutation(len(both))[:2000]], 6)
    row, leaf = forest.leaves(both)
    found = [set() for _ in both]
    for r, f in zip(row.tolist(), leaf.tolist(), strict=True):
        found[r].add(f)
    near = [k for k in range(1000) if x[k] @ y[k] >= 0.98]
    assert len(near) > 500
    assert np.mean([bool(found[k] & found[4000 + k]) for k in near]) >= 0.99
