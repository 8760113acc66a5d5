import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliant.llm import brown_lm as B
from tests.compare import SMALL


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def base(rows):
    counts, ends = Counter(), 0
    for d, t in rows:
        if not is_held(d):
            counts.update(tokens(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for d, t in rows:
        w = tokens(t)
        p = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))  # noqa: E731, B023
        out.append((d, is_held(d), len(w) + 1, sum(x in counts for x in w) + (ends > 0), total, sum(p(counts[x]) for x in w) + p(ends)))
    return out


def check(got, rows):
    key = lambda r: tuple(str(x) for x in r[:4])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(got, sorted(base(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("frequent", [B.FREQUENT, 40, 0])
def test_base_score_and_split_of_the_vocabulary(spark, scratch, frequent, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", B.is_held_out(docs.doc_id)).withColumnRenamed("doc_id", "id")
    model, rare = B.train(docs.where("not held_out").select("text"), scratch, frequent=frequent, exchange=min(frequent, 64), groups=32, n_classes=8)
    got = B.score(docs, model, rare, scratch).withColumnRenamed("id", "doc_id").collect()
    check(got, [(r.id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_model_is_a_distribution(spark, scratch):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60)
    model, rare = B.train(texts, scratch, frequent=1 << 18, exchange=64, groups=32, n_classes=8, least_moved=2)
    assert np.allclose((10**model.transition).sum(1), 1)
    k = len(model.transition)
    mass = np.zeros(k)
    counts = Counter(w for r in texts.collect() for w in tokens(r.text))
    import pyarrow as pa

    from foliant.llm.tokens import string_bytes, words

    names = list(counts)
    data, off = string_bytes(pa.array(names))
    w = words(data, off, 0, len(names))
    at, there = model.known.find(w.hash)
    cls = model.known.of(at, there, B.suffix_groups(data, 0, w.start, w.end, 32))
    assert there.all() and (model.counts[at] == [counts[n] for n in names]).all()
    # Frequent words beyond the units have left their groups.
    assert (cls != model.known.group_classes[B.suffix_groups(data, 0, w.start, w.end, 32)]).sum() > 64
    np.add.at(mass, cls, (np.array([counts[n] for n in names]) - model.discount) / 10 ** model.class_log[cls])
    seen = np.unique(cls)
    assert np.allclose(mass[seen] + 10 ** (model.unknown_log - model.class_log)[seen], 1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    truth = np.arange(40) % 4
    table = np.zeros((41, 41))
    for _ in range(40_000):
        a = rng.integers(40)
        b = rng.choice(np.flatnonzero(truth == (truth[a] + 1) % 4))
        table[a, b] += 1
    g = np.append(rng.integers(0, 4, 40), 4)

    def contexts(g):
        one = np.eye(5)[g]
        return table.T @ one, table @ one

    def likelihood(g):
        n = np.zeros((5, 5))
        np.add.at(n, (g[:, None], g[None, :]), table)
        return B._phi(n).sum() - B._phi(n.sum(1)).sum() - B._phi(n.sum(0)).sum()

    before = likelihood(g)
    for _ in range(6):
        g, _ = B.exchange_round(g, *contexts(g), np.diag(table).copy(), 40)
    assert likelihood(g) > before
    assert all(len(set(g[:40][truth == c].tolist())) == 1 for c in range(4))


def test_words_move_to_the_class_that_fits_their_neighbours():
    rng = np.random.default_rng(2)
    # Four classes in a ring; END is the fifth. Words of class c stand between those of c - 1 and c + 1.
    table = np.full((5, 5), 3.0)
    table[:, 4] = table[4] = 0
    for c in range(4):
        table[c, (c + 1) % 4] = 5000
    truth, now = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
    owner = np.repeat(np.arange(60), 2)
    slot = np.stack([(truth - 1) % 4, 5 + (truth + 1) % 4], 1).ravel()
    n = rng.integers(2, 30, 120)
    for w in range(60):
        table[now[w], slot[2 * w + 1] - 5] += n[2 * w + 1]
        table[slot[2 * w], now[w]] += n[2 * w]
    assert (B.best_classes(table, now, owner, slot, n) == truth).all()


def test_class_bigrams_are_counted_over_all_texts(spark, scratch):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    model, _ = B.train(texts, scratch, frequent=3000, exchange=64, groups=32, n_classes=8, least_moved=2)
    want = np.zeros((9, 9))
    import pyarrow as pa

    for r in texts.collect():
        for seq, *_ in B._sequences(pa.record_batch([pa.array([r.text])], ["text"]), model.known):
            np.add.at(want, (seq[:-1], seq[1:]), 1)
    got = B.count_classes(texts, model.known, 9)
    # Tasks join neighbouring texts by one END, so only END beside END depends on how texts are dealt.
    want[8, 8] = got[8, 8] = 0
    assert (got == want).all()


def test_edge_cases(spark, scratch):
    rows = [(1, None), (2, ""), (None, "A b"), (3, "a B a"), (3, "a B a"), (4, "x" * 3000 + " " + "word " * 4000), (10, "unknown words here"), (11, "\t\n ")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id bigint, text string, score double")
    got = B.score_texts(df, scratch).collect()
    check(got, rows)
    assert all(math.isfinite(r.score) for r in got)
    assert B.score_texts(df.limit(0), scratch).count() == 0


def test_no_training_text(spark, scratch):
    held = next(k for k in range(100) if is_held(k))
    df = spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")
    r = B.score_texts(df, scratch).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == pytest.approx(0)
