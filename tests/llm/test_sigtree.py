import random
import re

import numpy as np
import pytest

from foliant.llm import sigtree as S


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    sets, up = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if both and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * both:
                up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return [(d, len(sets[k]), low.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(docs)]


def near_copies(rnd, n_groups=12, copies=8, words=60, edits=4):
    vocabulary = [f"w{k}" for k in range(300)]
    shared = [rnd.choice(vocabulary) for _ in range(25)]
    docs = []
    for _ in range(n_groups):
        base = [rnd.choice(vocabulary) for _ in range(words)] + (shared if rnd.random() < 0.5 else [])
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            docs.append(" ".join(own))
    return docs


@pytest.mark.parametrize(("rounds", "block"), [(0, 1024), (2, 1024), (1, 3)])
def test_against_brute_force(spark, scratch, rounds, block, monkeypatch):
    rnd = random.Random(rounds + block)
    texts = near_copies(rnd) + [None, "", "  \n", "one two", "One  TWO", "a b c d", "a b c d e", "a b c d e", "x" * 5000]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    docs = [*zip(ids, texts, strict=True), (None, texts[0]), (5000, texts[0]), (5000, texts[0])]
    monkeypatch.setattr(S, "HEAVY_LEAST", 8)
    if block == 3:
        monkeypatch.setattr(S, "SMALL", 2)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, n bigint")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in S.jaccard_components(df, scratch, rounds=rounds, block=block).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(docs), key=key)


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.jaccard_components(df, scratch).count() == 0


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = []
    for _ in range(90):
        own = np.concatenate([rng.choice(base, rng.integers(40, 75), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)])
        sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets])
    maps = np.stack([S.bitmap(s, 8) for s in sets])
    open_pairs = {tuple(sorted(p)) for a, b in S.dual_traversal(S.SignatureTree(sizes, maps)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    linked = {(i, j) for i in range(90) for j in range(i + 1, 90) if len(np.intersect1d(sets[i], sets[j])) >= S.needed(sizes[i], sizes[j])}
    assert linked and linked <= open_pairs
    half = {(i, j + 45) for a, b in S.dual_traversal(S.SignatureTree(sizes[:45], maps[:45]), S.SignatureTree(sizes[45:], maps[45:])) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert {p for p in linked if p[0] < 45 <= p[1]} <= half


def test_fold_is_the_narrower_bitmap():
    x = np.random.default_rng(2).integers(0, 1 << 60, 200).astype(np.uint64)
    assert (S.fold(S.bitmap(x, 10)[None])[0] == S.bitmap(x, 9)).all()


def test_linked_sets_share_enough_keys():
    rng = np.random.default_rng(5)
    import pyarrow as pa

    order = S.Order(pa.table({"shingle": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}))
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        universe = np.unique(rng.integers(0, 1 << 60, 2 * n + 8).astype(np.uint64))
        rng.shuffle(universe)
        a = np.sort(universe[:n])
        drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
        b = np.sort(np.concatenate([rng.permutation(a)[drop:], universe[n : n + add]]))
        if len(b) and len(np.intersect1d(a, b)) >= S.needed(len(a), len(b)):
            shared = len(np.intersect1d(order.prefix(a), order.prefix(b)))
            for size in (len(a), len(b)):
                assert shared >= -(-(-(-S.NUM * size // S.DEN)) // S.KEY_SHARE)


def test_integer_bounds():
    for a in range(1, 60):
        for b in range(1, 60):
            exact = next((i for i in range(min(a, b) + 1) if 100 * i >= 75 * (a + b - i)), None)
            assert exact is None or S.needed(a, b) == exact
