"""LM scoring with Brown class-based bigrams whose classes come from exchange clustering.

P(w | v) = P(class of w | class of v) * P(w | class of w). Clustering has two steps. First the ``EXCHANGE`` most frequent words
and ``GROUPS`` groups of all other words by the hash of their last bytes are units: in rounds, Spark counts each unit's
neighbours by class (a table of at most units * classes rows, whatever the corpus), and the driver moves each
unit in turn to the class that raises the likelihood most, updating the class counts as it goes. Then every other word with
``LEAST_MOVED`` occurrences, among the ``FREQUENT`` most frequent ones, leaves its group: its neighbours by class are counted,
sharded by word, and tasks move words, each on its own, to the class that raises the likelihood most. So the number of
clustered words grows with the corpus up to that bound; rarer and unknown words keep the class of their group, which a task finds without a join.
Transitions and emissions are counted anew and smoothed by absolute discounting:
transitions fall back on class frequencies, and what a class's words lose goes to its unknown word.

Counts cover all training texts. The ``FREQUENT`` words that are most frequent are broadcast with their classes (a fixed
bound); all other words' counts stay sharded by word, and only occurrences of such words are shuffled to
them. Sums per text come from partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.tokens import _A, _LOWER, mix, slices, string_bytes, words
from foliant.llm.work import Scratch, map_batches

CLASSES, EXCHANGE, GROUPS, ROUNDS = 64, 4096, 1024, 4
FREQUENT = 1 << 18
SUFFIX = 3
#: Occurrences from which a word's neighbours tell more of its class than its last bytes.
LEAST_MOVED = 30
TRANSITION_DISCOUNT = 0.5
#: Distinct keys that a task gathers before it passes them on; fewer for neighbours of words, whose columns come beside.
HOLD, MOVE_HOLD = 1 << 20, 1 << 18
#: Neighbour counts of words compared with all classes at a time.
COMPARED = 1 << 13


def is_held_out(doc_id):
    """crc32 of the id as text is divisible by 10; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def suffix_groups(data: np.ndarray, base: int, start: np.ndarray, end: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A group for each word by its last SUFFIX bytes, lower-cased."""
    h = np.zeros(len(start), np.uint64)
    for k in range(1, SUFFIX + 1):
        there = end - k >= start
        h = h * _A + np.where(there, _LOWER[data[base + np.maximum(end - k, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(h) % np.uint64(groups)).astype(np.int64)


class _Sums:
    """Counts by 64-bit key that are merged whenever ``hold`` new ones have come."""

    def __init__(self, hold: int = HOLD):
        self.keys, self.extra, self.n, self.size, self.hold = [], [], [], 0, hold

    def add(self, key: np.ndarray, extra: np.ndarray | None = None) -> bool:
        u, first, n = np.unique(key, return_index=True, return_counts=True)
        self.keys.append(u)
        self.n.append(n)
        self.extra.append(extra[first] if extra is not None else np.zeros(0, np.int64))
        self.size += len(u)
        if self.size > 2 * self.hold:
            self.merge()
        return self.size > self.hold

    def merge(self) -> None:
        if self.keys:
            u, first, back = np.unique(np.concatenate(self.keys), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate(self.n), len(u)).astype(np.int64)
            extra = np.concatenate(self.extra)
            self.keys, self.n, self.extra, self.size = [u], [n], [extra[first] if len(extra) else extra], len(u)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        out = (self.keys[0], self.extra[0], self.n[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.__init__(self.hold)
        return out


def count_words(texts: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(word, grp, n) over all of texts(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def out():
            word, grp, n = sums.take()
            for k in range(0, len(word), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(word[s].view(np.int64)), pa.array(grp[s], pa.int32()), pa.array(n[s])], ["word", "grp", "n"])

        for batch in batches:
            data, off = string_bytes(batch.column("text"))
            for i, j in slices(off):
                w = words(data, off, i, j)
                if len(w.hash) and sums.add(w.hash, suffix_groups(data, int(off[i]), w.start, w.end, groups)) and sums.size > HOLD:
                    sums.merge()
                    if sums.size > HOLD:
                        yield from out()
        yield from out()

    return map_batches(texts, run, "word long, grp int, n long").groupBy("word", "grp").agg(F.sum("n").alias("n"))


class Units:
    """Units of words: a frequent word has its own, others that of their group; END stands between texts."""

    def __init__(self, top: np.ndarray, groups: int = GROUPS):
        order = np.argsort(top)
        self.words, self.ids, self.groups = top[order], order.astype(np.int64), groups
        self.end = len(top) + groups
        self.size = self.end + 1

    def of(self, hashes: np.ndarray, grp: np.ndarray) -> np.ndarray:
        out = len(self.words) + grp
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            same = self.words[k] == hashes
            out[same] = self.ids[k[same]]
        return out


def with_ends(units: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence END, words, END, words, ..., END of consecutive texts, and the place of each text's own END."""
    rows = len(first) - 1
    seq = np.full(len(units) + rows + 1, end, np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    seq[np.arange(len(units)) + row + 1] = units
    return seq, first[1:] + np.arange(rows) + 1


def count_bigrams(texts: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): neighbouring units, with END before and after each text."""
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, sums = shared.value, _Sums()

        def out():
            key, _, n = sums.take()
            for k in range(0, len(key), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array((key[s] // np.uint64(u.size)).astype(np.int32)), pa.array((key[s] % np.uint64(u.size)).astype(np.int32)), pa.array(n[s])], ["a", "b", "n"])

        for batch in batches:
            data, off = string_bytes(batch.column("text"))
            for i, j in slices(off):
                w = words(data, off, i, j)
                grp = suffix_groups(data, int(off[i]), w.start, w.end, u.groups)
                seq, _ = with_ends(u.of(w.hash, grp), w.first, u.end)
                if sums.add((seq[:-1] * u.size + seq[1:]).astype(np.uint64)):
                    sums.merge()
                    if sums.size > HOLD:
                        yield from out()
        yield from out()

    return map_batches(texts, run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _phi(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x * np.log(np.maximum(x, 1e-300))


def exchange_round(classes: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, fixed: int) -> tuple[np.ndarray, int]:
    """Moves each unit but ``fixed`` to its best class; ``left``[w, c] and ``right``[w, c] count neighbours of class c, ``own`` a unit beside itself.

    A class below 0 means that the unit has none yet and is not in the counts.
    """
    g, k = classes.copy(), left.shape[1]
    table = np.zeros((k, k))
    for w in np.flatnonzero(g >= 0):
        table[g[w]] += right[w]
    moved, diag = 0, np.arange(k)
    open_classes = np.arange(k - 1)
    weight = left.sum(1) + right.sum(1)
    for w in np.argsort(-weight, kind="stable"):
        if w == fixed or not weight[w]:
            continue
        l, r, s = left[w].copy(), right[w].copy(), own[w]
        was = g[w]
        if was >= 0:
            l[was] -= s
            r[was] -= s
            table[was] -= r
            table[:, was] -= l
            table[was, was] -= s
            np.maximum(table, 0, out=table)
        rows, cols = table.sum(1), table.sum(0)
        phi = _phi(table)
        gain_r = _phi(table + r) - phi
        gain_l = _phi(table + l[:, None]) - phi
        corner = _phi(table[diag, diag] + l + r + s) - phi[diag, diag]
        gain = gain_r.sum(1) - gain_r[diag, diag] + gain_l.sum(0) - gain_l[diag, diag] + corner
        gain -= _phi(rows + r.sum() + s) - _phi(rows) + _phi(cols + l.sum() + s) - _phi(cols)
        best = int(open_classes[np.argmax(gain[open_classes])])
        moved += best != was
        g[w] = best
        table[best] += r
        table[:, best] += l
        table[best, best] += s
    return g, moved


def _contexts(bigrams: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each unit by class, before and after it; at most units * classes rows reach the driver."""
    spark = bigrams.sparkSession
    known = np.flatnonzero(classes >= 0)
    named = spark.createDataFrame(pa.table({"unit": pa.array(known, pa.int32()), "class": pa.array(classes[known], pa.int32())}))
    out = []
    for unit, other in (("b", "a"), ("a", "b")):
        rows = bigrams.join(F.broadcast(named.withColumnRenamed("unit", other)), other).groupBy(F.col(unit).alias("unit"), "class").agg(F.sum("n").alias("n")).toArrow()
        m = np.zeros((len(classes), n_classes))
        m[rows.column("unit").to_numpy(), rows.column("class").to_numpy()] = rows.column("n").to_numpy()
        out.append(m)
    return out[0], out[1]


def cluster(bigrams: DataFrame, units: Units, counts: np.ndarray, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts). END has the last class to itself; units never seen join the class of END's neighbours, 0."""
    k = n_classes + 1
    g = np.full(units.size, -1)
    g[units.end] = n_classes
    seen = np.argsort(-counts[: units.end], kind="stable")
    g[seen[:n_classes]] = np.arange(min(n_classes, units.end))
    own = np.zeros(units.size)
    rows = bigrams.where("a = b").toArrow()
    own[rows.column("a").to_numpy()] = rows.column("n").to_numpy()
    for _ in range(rounds):
        left, right = _contexts(bigrams, g, k)
        # Of a unit without a class, its own pairs are in no count yet.
        new, moved = exchange_round(g, left, right, own, units.end)
        settled = moved <= units.size // 200 and (g >= 0).all()
        g = new
        if settled:
            break
    g = np.where(g < 0, 0, g)
    _, right = _contexts(bigrams, g, k)
    table = np.zeros((k, k))
    np.add.at(table, g, right)
    return g, table


class WordClasses:
    """Classes of words: frequent ones have their own, others that of their suffix group."""

    def __init__(self, words: np.ndarray, classes: np.ndarray, group_classes: np.ndarray, end: int):
        self.words, self.classes, self.group_classes, self.groups, self.end = words, classes.astype(np.int64), group_classes.astype(np.int64), len(group_classes), end

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the frequent words, whether there)."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return k, self.words[k] == hashes

    def of(self, at: np.ndarray, there: np.ndarray, grp: np.ndarray) -> np.ndarray:
        out = self.group_classes[grp]
        out[there] = self.classes[at[there]]
        return out


def _sequences(batch: pa.RecordBatch, c: WordClasses) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices: the classes of consecutive texts with ends between, the place of each word in them, and the words found."""
    data, off = string_bytes(batch.column("text"))
    for i, j in slices(off):
        w = words(data, off, i, j)
        at, there = c.find(w.hash)
        seq, _ = with_ends(c.of(at, there, suffix_groups(data, int(off[i]), w.start, w.end, c.groups)), w.first, c.end)
        yield seq, np.arange(len(at)) + np.repeat(np.arange(j - i), w.counts) + 1, at, there


def move_words(texts: DataFrame, known: WordClasses, table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of each of the known words after those of ``own`` moved to the class that raises the likelihood most."""
    spark, k = texts.sparkSession, len(table)
    shared = spark.sparkContext.broadcast((known, table, own))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c, _, mine), sums = shared.value, _Sums(MOVE_HOLD)

        def out():
            key, _, n = sums.take()
            for lo in range(0, len(key), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array((key[s] // np.uint64(2 * k)).astype(np.int32)), pa.array((key[s] % np.uint64(2 * k)).astype(np.int32)), pa.array(n[s])], ["word", "slot", "n"])

        for batch in batches:
            for seq, place, at, there in _sequences(batch, c):
                place, at = place[there], at[there]
                place, at = place[mine[at]], at[mine[at]]
                if not len(at):
                    continue
                key = np.concatenate([at * 2 * k + seq[place - 1], at * 2 * k + k + seq[place + 1]])
                if sums.add(key.astype(np.uint64)):
                    sums.merge()
                    if sums.size > MOVE_HOLD:
                        yield from out()
        yield from out()

    contexts = map_batches(texts, count, "word int, slot int, n long").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    # A word has two rows per class at most.
    contexts = contexts.groupBy("word").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t, _ = shared.value
        for batch in batches:
            word, slots, ns = batch.column("word").to_numpy(), batch.column("slots"), batch.column("ns")
            owner = np.repeat(np.arange(len(word)), pc.list_value_length(slots).to_numpy())
            slots, ns, best = slots.flatten().to_numpy(), ns.flatten().to_numpy(), np.zeros(len(word), np.int64)
            for part in np.split(np.arange(len(word)), np.flatnonzero(np.diff(np.searchsorted(owner, np.arange(len(word))) // COMPARED)) + 1):
                if len(part):
                    lo, hi = np.searchsorted(owner, [part[0], part[-1] + 1])
                    best[part] = best_classes(t, c.classes[word[part]], owner[lo:hi] - part[0], slots[lo:hi], ns[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(best, pa.int32())], ["word", "class"])

    found = map_batches(contexts, assign, "word int, class int").toArrow()
    out = known.classes.copy()
    out[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return out


def best_classes(table: np.ndarray, now: np.ndarray, owner: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For words of classes ``now`` and neighbour counts (owner, slot, n), the class but the last with the greatest gain.

    ``slot`` is the class of a neighbour before the word, or k more than that of one after it. A word's own counts are
    taken out of its class first, so that staying is worth as much as moving in.
    """
    k, m, n = len(table), len(now), n.astype(np.float64)
    after = slot >= k
    # Class counts beside each neighbour: for one after the word the rows, for one before it the columns.
    beside = np.where(after[:, None], table.T[slot % k], table[slot % k])
    stay = np.zeros(beside.shape, bool)
    stay[np.arange(len(slot)), now[owner]] = True
    base = np.where(stay, np.maximum(beside - n[:, None], 0), beside)
    gain = np.zeros((m, k))
    np.add.at(gain, owner, _phi(base + n[:, None]) - _phi(base))
    for side, total in ((after, table.sum(1)), (~after, table.sum(0))):
        own = np.bincount(owner[side], n[side], m)[:, None]
        base = np.where(np.arange(k) == now[:, None], np.maximum(total - own, 0), total)
        gain -= _phi(base + own) - _phi(base)
    return np.argmax(gain[:, : k - 1], 1)


def count_classes(texts: DataFrame, known: WordClasses, k: int) -> np.ndarray:
    """How often each class stands before each other one; a task passes on one table."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for seq, *_ in _sequences(batch, shared.value):
                total += np.bincount(seq[:-1] * k + seq[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    sums = map_batches(texts, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(k * k)
    table[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    return table.reshape(k, k)


class Model:
    """All that scoring needs but the counts of rare words."""

    def __init__(self, known: WordClasses, counts: np.ndarray, table: np.ndarray, types: np.ndarray, total: int, distinct: int, ends: int, discount: float):
        self.known, self.counts = known, counts
        self.total, self.distinct, self.ends, self.discount = total, distinct, ends, discount
        k = len(table)
        count = table.sum(0)
        prior = (count + 1) / (count.sum() + k)
        rows = table.sum(1, keepdims=True)
        d = TRANSITION_DISCOUNT * (table > 0)
        p = np.where(rows > 0, (table - d + d.sum(1, keepdims=True) * prior) / np.maximum(rows, 1), prior)
        self.transition = np.log10(p)
        with np.errstate(divide="ignore"):
            self.class_log = np.where(count > 0, np.log10(np.maximum(count, 1)), 0.0)
            unknown = np.where(count > 0, np.maximum(discount * types, 1e-9), 1.0)
            self.unknown_log = np.log10(unknown)
        self.base_log = math.log10(total + 0.1 * (distinct + 1)) if total else math.log10(0.1)


def train(texts: DataFrame, scratch: Scratch, n_classes: int = CLASSES, exchange: int = EXCHANGE, groups: int = GROUPS, frequent: int = FREQUENT, least_moved: int = LEAST_MOVED) -> tuple[Model, DataFrame]:
    """A model of texts(text) and the table (word, n) of the words that are not frequent."""
    spark = texts.sparkSession
    vocab = scratch.write(count_words(texts, groups), "vocab")
    ends = texts.count()
    bucket = F.floor(F.log(2.0, F.col("n")) * 16).cast("int")
    steps = vocab.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("types"), F.min("n").alias("least"), F.sum("n").alias("n")).orderBy(F.desc("bucket")).collect()
    one, two = (vocab.where(F.col("n") == k).count() for k in (1, 2))
    least, held = None, 0
    for r in steps:
        held += r.types
        if held > frequent:
            break
        least = r.least
    chosen = vocab.where(F.col("n") >= least).toArrow() if least is not None else vocab.limit(0).toArrow()
    word, n = chosen.column("word").to_numpy().view(np.uint64), chosen.column("n").to_numpy()
    order = np.lexsort((word, -n))
    units = Units(word[order[:exchange]], groups)
    by_word = np.argsort(word)
    top = spark.createDataFrame(pa.table({"word": pa.array(units.words.view(np.int64)), "unit": pa.array(units.ids)}))
    per_unit = vocab.join(F.broadcast(top), "word", "left").groupBy(F.coalesce("unit", F.col("grp") + len(units.words)).alias("unit")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).toArrow()
    types, counts = np.zeros(units.size), np.zeros(units.size)
    at = per_unit.column("unit").to_numpy()
    types[at], counts[at] = per_unit.column("types").to_numpy(), per_unit.column("n").to_numpy()
    bigrams = scratch.write(count_bigrams(texts, units), "bigrams")
    classes, table = cluster(bigrams, units, counts, n_classes)
    scratch.drop("bigrams")
    # Frequent words that are no units leave their groups.
    word, n, grp = word[by_word], n[by_word], chosen.column("grp").to_numpy()[by_word]
    tail, at = ~np.isin(word, units.words), np.zeros(len(word), np.int64)
    at[~tail] = units.of(word[~tail], grp[~tail])
    at[tail] = len(units.words) + grp[tail]
    group_classes = classes[len(units.words) : units.end]
    known = WordClasses(word, classes[at], group_classes, n_classes)
    moving = tail & (n >= least_moved)
    if moving.any():
        known = WordClasses(word, move_words(texts, known, table, moving), group_classes, n_classes)
        table = count_classes(texts, known, len(table))
    total, distinct = int(counts.sum()) + ends, int(types.sum()) + (ends > 0)
    discount = one / (one + 2 * two) if one and two else 0.5
    # Types of a class: its frequent words and the rare ones of its groups.
    rare = types[len(units.words) : units.end] - np.bincount(grp[tail], minlength=groups)
    of_class = np.bincount(known.classes, minlength=len(table)) + np.bincount(group_classes, rare, len(table))
    model = Model(known, n, table, of_class, total, distinct, ends, discount)
    return model, vocab.where(F.col("n") < least).select("word", "n") if least is not None else vocab.select("word", "n")


def score(docs: DataFrame, model: Model, rare: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(id, held_out, text) with n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = shared.value
        uid = TaskContext.get().partitionId() << 36
        end_base = math.log10(m.ends + 0.1)
        for batch in batches:
            data, off = string_bytes(batch.column("text"))
            n = batch.num_rows
            tokens, known, base, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, j in slices(off):
                w = words(data, off, i, j)
                rows = j - i
                at, seen = m.known.find(w.hash)
                k = m.known.of(at, seen, suffix_groups(data, int(off[i]), w.start, w.end, m.known.groups))
                cls, places = with_ends(k, w.first, m.known.end)
                steps = np.concatenate([[0.0], np.cumsum(m.transition[cls[:-1], cls[1:]])])
                row = np.repeat(np.arange(rows), w.counts)
                c = np.where(seen, m.counts[at], 0) if len(m.counts) else np.zeros(len(at), np.int64)
                tokens[i:j] = w.counts + 1
                known[i:j] = np.bincount(row[seen], minlength=rows) + (m.ends > 0)
                base[i:j] = np.bincount(row[seen], np.log10(c[seen] + 0.1), rows) + end_base - tokens[i:j] * m.base_log
                emitted = np.bincount(row[seen], np.log10(c[seen] - m.discount), rows) - np.bincount(row, m.class_log[k], rows)
                total[i:j] = emitted + np.diff(steps[np.concatenate([[0], places])])
                other = ~seen
                lists.append((np.bincount(row[other], minlength=rows), w.hash[other], m.unknown_log[k[other]]))
            sizes, hashes, unknown = (np.concatenate([x[q] for x in lists]) if lists else np.zeros(0) for q in range(3))
            where = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid + np.arange(n)), batch.column("id"), batch.column("held_out"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(total), pa.ListArray.from_arrays(where, pa.array(hashes.astype(np.uint64).view(np.int64))), pa.ListArray.from_arrays(where, pa.array(unknown.astype(np.float64)))],
                ["uid", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "others", "unknown"],
            )
            uid += n

    first = scratch.write(map_batches(docs.select("id", "held_out", "text"), run, f"uid long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, others array<long>, unknown array<double>"), "scored")
    spread = first.select("uid", F.inline(F.arrays_zip(F.col("others").alias("word"), F.col("unknown").alias("unknown"))))
    spread = spread.groupBy("uid", "word").agg(F.count("*").alias("times"), F.first("unknown").alias("unknown"))
    met = spread.join(rare, "word", "left")
    sums = met.groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1))).alias("more_base"),
        F.sum(F.col("times") * F.when(F.col("n").isNotNull(), F.log10(F.col("n") - F.lit(model.discount))).otherwise(F.col("unknown"))).alias("more_score"),
    )
    out = first.drop("others", "unknown").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_score") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_texts(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Learns from the texts that are not held out and scores all; one row per row of ``docs``.

    Null texts are empty: one END token. Without any training text all counts are 0. Rows that repeat are scored alike and
    count as often as they stand; a null id counts as the empty text for the fold. Words of equal counts take their turn in
    the order of their hashes. Texts of any length are read whole, one at a time; other columns, whatever their names, are not
    read. An empty table gives no rows.
    """
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("held_out", is_held_out(F.col("id")))
    model, rare = train(base.where(~F.col("held_out")).select("text"), scratch)
    return score(base, model, rare, scratch).withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of ``documents``."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "brown"))
