import random

import numpy as np
import pyarrow as pa

from foliant.llm import decontam as D
from tests.compare import SMALL


def levenshtein(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(1000):
        p, t = ("".join(rnd.choice("abé ") for _ in range(rnd.randint(0, n))) for n in (12, 25))
        assert D.edit_distance(p, t) == (levenshtein(p, t) if p else 0)


def noisy(words, rate, rnd, vocabulary):
    words = list(words)
    for _ in range(max(1, round(rate * len(words)))):
        k = rnd.randrange(len(words))
        match rnd.choice("sid"):
            case "s":
                words[k] = rnd.choice(vocabulary)
            case "i":
                words.insert(k, rnd.choice(vocabulary))
            case _:
                del words[k]
    return words


def test_recall_of_edited_copies():
    rnd = random.Random(2)
    vocabulary = [f"{rnd.choice('abcdefgh')}{rnd.choice('aeiou')}{rnd.choice('rstln')}{rnd.choice('aeiou')}{k % 9}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 60)))) for k in range(60)]
    index, texts, want = D.Index(items), [], []
    for n in range(300):
        k = rnd.randrange(len(items))
        words = noisy(items[k][1].split(), rnd.choice((0.03, 0.08, 0.12)), rnd, vocabulary) if n % 3 else items[k][1].upper().split()
        filler = [rnd.choice(vocabulary) for _ in range(80)]
        text = " ".join([*filler[:40], *words, *filler[40:]])
        if levenshtein(index.items[k][1], D.normalise(text)) <= D.MAX_EDIT * len(index.items[k][1]):
            texts.append(text)
            want.append(k)
    found = D.leaks_in(pa.array(texts), index)
    assert np.mean([(r, k) in found for r, k in enumerate(want)]) >= 0.95
    exact = [(r, k) for r, k in enumerate(want) if index.items[k][1] in D.normalise(texts[r])]
    assert exact and all(found[p] == 0 for p in exact)
    assert all(levenshtein(index.items[k][1], D.normalise(texts[r])) <= D.MAX_EDIT * len(index.items[k][1]) for r, k in found)


def test_exact_copies_in_the_table_are_all_found(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    texts = {r.doc_id: D.normalise(r.text or "") for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if f" {D.normalise(r.text)} " in f" {t} "}
    assert want and want <= got
    clean = {r.doc_id for r in D.remove_leaks(docs, items).collect()}
    assert clean == set(texts) - {d for d, _ in got}


def test_edge_cases(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, None), (2, ""), (3, f"x {item.lower()}!"), (None, item), (3, item), (4, "word " * 20_000 + item + " end")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "...")], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in D.find_leaks(docs, items).collect()), key=str)
    assert got == sorted([(3, 1, 0), (3, 1, 0), (None, 1, 0), (4, 1, 0)], key=str)
    assert [(r.doc_id, r.item_id) for r in D.remove_leaks(docs, items).orderBy("doc_id").collect()] == [(1, 7), (2, 7)]
    assert D.find_leaks(docs.limit(0), items).count() == D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.find_leaks(docs, items.unionByName(spark.createDataFrame([(9, "Some other item of words")], items.schema)), block=1).count() == 4


def test_recall_of_character_edits():
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(15, 60)))) for k in range(60)]
    index = D.Index(items)
    for rate in (0.02, 0.05, 0.08, 0.1, 0.12, 0.14, 0.149):
        texts, want = [], []
        for _ in range(60):
            k = rnd.randrange(len(items))
            chars = list(items[k][1])
            for p in rnd.sample(range(len(chars)), int(rate * len(chars))):
                chars[p] = rnd.choice((rnd.choice(letters), "", chars[p] + rnd.choice(letters)))
            filler = [rnd.choice(vocabulary) for _ in range(40)]
            texts.append(" ".join([*filler[:20], "".join(chars), *filler[20:]]))
            want.append(k)
        found = D.leaks_in(pa.array(texts), index)
        assert np.mean([(r, k) in found for r, k in enumerate(want)]) >= 0.9


def test_pruning_loses_no_match():
    rnd, met = random.Random(4), 0
    for n in range(300):
        item = "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(5, 400 if n % 3 == 0 else 80)))
        index = D.Index([(1, item)])
        if not index.items:
            continue
        copy = D.normalise("".join(rnd.choice((*(c,) * 20, "", "x", c + "y")) for c in item) + " abc")
        before = D.normalise("".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(0, 90))))
        text = before + copy
        sign, _ = D.symbols(np.frombuffer(text.encode(), np.uint8))
        one, ends = np.zeros(1, np.int64), np.array([len(sign)])
        if D.edit_distance(index.items[0][1], copy) <= index.most[0]:
            met += 1
            slack = rnd.randint(0, 10)
            assert index.may_match(D.Grams(sign), one, np.array([len(before) - rnd.randint(0, slack)]), np.array([slack]), one, ends).all()
    assert met > 50


def test_capitals_of_all_scripts():
    items = [(1, "Der Übergang der Äpfel und Öle über die Straße in Zürich"), (2, "ПРИВЕТ Мир это длинная строка для Проверки Текста Целиком"), (3, "İSTANBUL ve ΣΟΦΟΣ Kelvin K eski bir Şehir Çok Güzel Yer")]
    texts = pa.array([f"x {f(t)} y" for _, t in items for f in (str, str.lower, lambda x: x)])
    found = D.leaks_in(texts, D.Index(items))
    assert all(found[3 * k + j, k] == 0 for k in range(2) for j in range(3))
    assert found[6, 2] == found[8, 2] == 0
    assert {k for r, k in found if r == 7} == {2}


def test_texts_without_any_shared_word():
    index = D.Index([(1, "one two three four five six seven eight nine ten")])
    texts = pa.array([" ".join(f"u{k}x{n}" for k in range(3000)) for n in range(20)])
    assert D.leaks_in(texts, index) == {}


def test_exact_copies_of_short_items_are_found():
    rnd = random.Random(6)
    for n in range(1, 9):
        items = [(k, " ".join(f"{'abcdefgh'[n - 1]}{rnd.randrange(10**6)}" for _ in range(n))) for k in range(50)]
        texts = [" ".join([*(f"w{rnd.randrange(500)}" for _ in range(30)), t, *(f"w{rnd.randrange(500)}" for _ in range(30))]) for _, t in items]
        found = D.leaks_in(pa.array(texts), D.Index(items))
        assert all(found.get((k, k)) == 0 for k in range(50)), n


def test_items_without_an_id_are_removed(spark):
    docs = spark.createDataFrame([(1, "so then quiet river stones gather moss slowly it ends"), (2, "nothing of the kind")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "quiet river stones gather moss slowly"), (5, "something else")], "item_id bigint, text string")
    assert [r.doc_id for r in D.remove_leaks(docs, items).collect()] == [2]
    assert D.find_leaks(docs, items).count() == 0


def test_only_ngrams_with_a_flag_are_looked_up(monkeypatch):
    rnd, denied, looked = random.Random(7), set(), []
    flagged, stands = D.Grams.flagged, D.Grams.stands

    def told(self, name, low, steps):
        out = flagged(self, name, low, steps)
        name, low = (np.broadcast_to(x, out.shape)[~out].tolist() for x in (name, low))
        denied.update(zip(name, low, strict=True))
        return out

    def asked(self, name, low, high):
        looked.extend(zip(name.tolist(), low.tolist(), strict=True))
        return stands(self, name, low, high)

    monkeypatch.setattr(D.Grams, "flagged", told)
    monkeypatch.setattr(D.Grams, "stands", asked)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8))) for _ in range(60)]
    index = D.Index([(1, " ".join(words))])
    # Neighbouring pieces of the item change places: flags tell of many n-grams, but none is as near as an alignment asks for.
    text = " ".join(x for k in (12, 0, 36, 24) for x in words[k : k + 12])
    sign, _ = D.symbols(np.frombuffer(text.encode(), np.uint8))
    at = np.array([0, 5])
    zero = np.zeros(len(at), np.int64)
    assert not index.may_match(D.Grams(sign), zero, at, zero + 5, zero, zero + len(sign)).any()
    assert looked and denied and not denied.intersection(looked)


def test_results_do_not_depend_on_the_sizes_of_batches(monkeypatch):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice((1, 2, 3, 9, 40, 200))))) for k in range(40)]
    texts = []
    for _ in range(60):
        passage = noisy(rnd.choice(items)[1].split(), 0.04, rnd, words)
        texts.append(" ".join([*(rnd.choice(words) for _ in range(30)), *passage, *(rnd.choice(words) for _ in range(30))]))
    want = D.leaks_in(pa.array(texts), D.Index(items))
    for name, size in (("CHUNK", 50), ("BATCH", 64), ("SLICE", 100)):
        monkeypatch.setattr(D, name, size)
        assert D.leaks_in(pa.array(texts), D.Index(items)) == want and want
