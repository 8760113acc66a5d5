"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification.

The CGK random walk turns edit distance into Hamming distance: a pointer steps through a string and at
each step emits the symbol under it, then advances or stays as a random function of step and symbol says,
so two strings that differ by a few edits soon walk in step again. Here the symbols are words. Windows of
each text, of size classes fitted to the items, start at local minima of a hash of two neighbouring words
(so a passage shared with an item starts a window inside it); windows of the items start everywhere. Of
each walk several tables each hash a few sampled steps. Windows of one or two words, too short for a walk to fall in
step again, have one table of all their words and start at every word of the text: they find items of which many
words have an edit, as in typing or recognition errors. Every window that falls in a bucket of an item is
verified: an alignment through it with at most ``max_edit`` edits a character keeps most n-grams of the item, each about
as far from the window as in the item. Where too few are, there is none; elsewhere the item is aligned with
the passage by exact edit distance of characters (Myers' bit vectors, free ends in the text).

Items and texts are lower-cased alike, by the characters of all scripts, before anything is hashed.

Texts are never shuffled. Items go to the tasks in blocks of at most ``BLOCK`` items and ``BLOCK_BYTES``
bytes, so nothing that is broadcast grows with the benchmark; each block is a pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.license_scan import _SEP
from foliant.llm.tokens import _LOWER, mix, slices, string_bytes, words
from foliant.llm.work import map_batches

MAX_EDIT = 0.15
WALKS, TABLES, SAMPLES, SPACING = 3, 8, 5, 4
#: Window sizes in words are powers of two; an item uses the largest that leaves SPACING words of it for a window to start, and SEED.
SEED = 2
#: Size classes with one table of all words, looked up at every word of a text.
DENSE = (1, 2)
#: Length of the n-grams that a passage is pruned by, n-grams and collisions looked up at a time.
GRAM, BATCH, CHUNK = 5, 1 << 16, 1 << 17
#: Bytes of text read at a time; the n-grams of so many should set few of all flags.
SLICE = 1 << 18
#: Bits of a place in a slice of text, below those of the n-gram that begins there.
PLACE = 40
#: log2 of the places in a stretch of text, of the flags that tell which n-grams stand in which stretch, of the names of n-grams, and the most stretches looked up.
STRETCH, FLAGS, NAME, STRETCHES = 7, 22, 22, 8
_FLAG = np.uint32((1 << FLAGS) - 1)
BLOCK, BLOCK_BYTES = 4096, 4 << 20
_A, _A32 = np.uint64(0xD6E8FEB86659FD93), np.uint32(0x9E3779B1)
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def normalise(text: str) -> str:
    """Lower case, words of letters, digits and characters above 0x7F, one space between them."""
    return squash(pc.utf8_lower(text).as_py())


def squash(text: str) -> str:
    return " ".join(_WORD.findall(text))


def edit_distance(pattern: str, text: str) -> int:
    """Fewest edits that turn ``pattern`` into some substring of ``text`` (Myers, 1999)."""
    m = len(pattern)
    if not m:
        return 0
    if pattern in text:
        return 0
    peq: dict[str, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        # The text's end is free, so the first row of the table is zero throughout.
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        best = min(best, score)
    return best


class Index:
    """Hash tables of the windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float = MAX_EDIT, walks: int = WALKS, tables: int = TABLES, samples: int = SAMPLES, seed: int = 11):
        self.max_edit, rng = max_edit, np.random.default_rng(seed)
        self.items = [(i, normalise(t or "")) for i, t in items]
        self.items = [(i, t) for i, t in self.items if t]
        hashes = []
        for _, t in self.items:
            data = np.frombuffer(t.encode(), np.uint8)
            hashes.append(words(data, np.array([0, len(data)]), 0, 1, _SEP, _LOWER).hash)
        self.n_chars = np.array([len(t) for _, t in self.items], np.int64)
        self.most = np.array([int(max_edit * len(t)) for _, t in self.items], np.int64)
        signs = [symbols(np.frombuffer(t.encode(), np.uint8))[0] for _, t in self.items]
        # N-grams of the items: those that do not overlap, and all.
        self.grams = []
        for apart in (GRAM, 1):
            own = [_gram_hash(x)[::apart] for x in signs]
            self.grams.append((np.concatenate([np.zeros(0, np.uint32), *own]), np.cumsum([0, *map(len, own)]), apart))
        # Which n-grams flags are asked for.
        self.asked = np.zeros(1 << NAME, bool)
        self.asked[self.grams[0][0]] = True
        self.n_words = np.array([len(h) for h in hashes], np.int64)
        size = np.array([1 << max(0, int(n - SPACING).bit_length() - 1) if n > SPACING else 1 for n in self.n_words], np.int64)
        self.classes = sorted(set(size.tolist()) | ({SEED} if size.max(initial=0) > SEED else set()))
        self.steps = 2 * max(self.classes, default=1)
        self.seeds = rng.integers(1, 1 << 62, walks).astype(np.uint64)
        self.plan: list[dict[int, list[tuple[int, int]]]] = []
        for _ in range(walks):
            steps: dict[int, list[tuple[int, int]]] = {}
            for c in self.classes:
                for t in range(0 if c in DENSE else tables):
                    edges = np.linspace(0, 2 * c, min(samples, c) + 1)
                    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                        at = int(rng.integers(int(lo), max(int(lo) + 1, int(hi))))
                        steps.setdefault(at, []).append((c, t))
            self.plan.append(steps)
        owner = np.repeat(np.arange(len(hashes)), self.n_words)
        offset = np.concatenate([np.arange(n) for n in self.n_words]) if len(hashes) else np.zeros(0, np.int64)
        self.flag: dict[tuple[int, int, int], tuple[np.uint64, np.uint32, np.ndarray]] = {}
        codes, windows, firsts, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [], 0
        if hashes:
            flat = np.concatenate(hashes)
            # Characters of the item before each word.
            self.before = np.concatenate([np.cumsum([0] + [len(x) + 1 for x in t.split(" ")])[:-1] for _, t in self.items])
            self.word_of = np.concatenate([[0], np.cumsum(self.n_words)])
            every = np.arange(len(flat))
            for (walk, c, t), key in chain(self.keys(flat, every), self.dense_keys(flat)):
                mine = np.flatnonzero(((size[owner] == c) | (c == SEED) & (size[owner] > c)) & (offset + c <= np.maximum(self.n_words[owner], c)))
                # The upper bits of a product are the mixed ones; some thirty flags a window, as far as a cache holds them.
                bits = min(20, max(14, len(mine).bit_length() + 5))
                shift, flag = np.uint32(32 - bits), np.zeros(1 << bits, bool)
                flag[key[mine] >> shift] = True
                number = np.uint64(len(self.flag) << 32)
                self.flag[walk, c, t] = (number, shift, flag)
                mine = mine[np.argsort(key[mine], kind="stable")]
                code, first = np.unique(key[mine], return_index=True)
                codes.append(code | number)
                windows.append(mine.astype(np.int32))
                firsts.append((first + total).astype(np.int32))
                total += len(mine)
        # Windows of all tables by code, the table's number above the key.
        self.code, self.window, self.first = np.concatenate(codes), np.concatenate(windows), np.concatenate([*firsts, np.array([total], np.int32)])
        self.owner, self.offset = owner, offset

    def keys(self, flat: np.ndarray, start: np.ndarray) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        """32-bit hash of each table for windows that start at ``start`` in the words ``flat``."""
        for walk, seed in enumerate(self.seeds):
            symbol = np.concatenate([mix(flat + seed), np.zeros(self.steps + 1, np.uint64)])
            at, sums = start.astype(np.int64), {}
            s, bit = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
            for step in range(max(self.plan[walk], default=-1) + 1):
                np.take(symbol, at, out=s, mode="clip")
                plan = self.plan[walk].get(step, ())
                if plan:
                    low = s.astype(np.uint32)
                for c, t in plan:
                    if (c, t) in sums:
                        sums[c, t] ^= low
                        sums[c, t] *= _A32
                    else:
                        sums[c, t] = low * _A32
                np.right_shift(s, np.uint64(step & 63), out=bit)
                bit &= np.uint64(1)
                at += bit.view(np.int64)
            for (c, t), x in sums.items():
                yield (walk, c, t), x

    def dense_keys(self, flat: np.ndarray) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        """32-bit hash of all words of the windows of DENSE classes that start at each of the words ``flat``."""
        for c in self.classes:
            if c in DENSE:
                x, padded = np.zeros(len(flat), np.uint64), np.concatenate([flat, np.zeros(c, np.uint64)])
                for k in range(c):
                    x = mix((x ^ padded[k : k + len(flat)]) * _A)
                yield (0, c, 0), (x >> np.uint64(32)).astype(np.uint32)

    def candidates(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Word positions, items and offsets in them, of windows that share a bucket with one of an item, about CHUNK at a time."""
        starts, every = anchors(flat), np.arange(len(flat))
        held, size = [], 0
        for name, key in chain(self.keys(flat, starts), self.dense_keys(flat)):
            number, shift, flag = self.flag[name]
            hit = np.flatnonzero(flag.take(key >> shift))
            for k in range(0, len(hit), CHUNK):
                some = hit[k : k + CHUNK]
                held.append((key[some] | number, some if name[1] in DENSE else starts[some]))
                size += len(some)
                if size >= CHUNK:
                    yield from self._windows(held)
                    held, size = [], 0
        if held:
            yield from self._windows(held)

    def _windows(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The items' windows of each code, beside the place that goes with it."""
        code, place = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(self.code):
            return
        at = np.searchsorted(self.code, code)
        known = np.flatnonzero(self.code.take(at, mode="clip") == code)
        at, place = at[known], place[known]
        n = self.first[at + 1] - self.first[at]
        for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // CHUNK)) + 1):
            if len(cut):
                k, which = _spread(self.first[at[cut]].astype(np.int64), n[cut].astype(np.int64))
                window = self.window[which]
                yield place[cut][k], self.owner[window], self.offset[window]

    def may_match(self, grams: Grams, item: np.ndarray, at: np.ndarray, slack: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether an alignment of the item that begins, edits aside, in at..at + slack of the text may have few enough edits.

        ``begin`` and ``end`` bound the row of the text. An edit changes GRAM of the item's n-grams at most, one of those
        that do not overlap, and moves what follows by one place; so the n-grams that it keeps stand within
        ``most`` places of where they would without edits. Flags are asked first, which say yes a little too often, so only
        n-grams that they tell of are then looked up.
        """
        low = at - self.most[item]
        span = slack + 2 * self.most[item]
        # Items of one size together, as n-grams and flags are asked for over the widest of a batch.
        order, out = np.argsort(self.n_chars[item], kind="stable"), np.zeros(len(item), bool)

        def stands(c: np.ndarray, own: np.ndarray, place: np.ndarray) -> np.ndarray:
            start = low[c] + place
            last = np.minimum(start + span[c], end[c] - GRAM)
            return grams.stands(own, np.maximum(start, begin[c]), last)

        for (own, first, apart), flags in zip(self.grams, (True, False), strict=True):
            look = order if flags else order[out[order]]
            begins, count = first[item[look]], np.diff(first)[item[look]]
            need = count - self.most[item[look]] * (GRAM // apart)
            out[look] = need <= 0
            todo = np.flatnonzero(need > 0)
            # Counts of a batch differ by less than a factor of two.
            cut = np.diff(np.cumsum(count[todo]) // BATCH) | np.diff(np.frexp(count[todo])[1])
            for part in np.split(todo, np.flatnonzero(cut) + 1):
                if not len(part):
                    continue
                step = np.arange(count[part].max(), dtype=np.int32)[:, None]
                asked = step < count[part]
                if flags:
                    steps = (int(span[look[part]].max()) >> STRETCH) + 2
                    asked &= grams.flagged(own.take(begins[part] + step, mode="clip"), low[look[part]].astype(np.int32) + step * np.int32(apart), steps)
                    few = np.add.reduce(asked, 0, np.int32) < need[part]
                    part, asked = part[~few], asked[:, ~few]
                j, k = np.nonzero(asked)
                n = np.bincount(k, stands(look[part[k]], own[begins[part[k]] + j], j * apart), len(part))
                out[look[part]] = n >= need[part]
        return out


class Grams:
    """Where the n-grams of a slice of text stand."""

    def __init__(self, sign: np.ndarray, flag: np.ndarray | None = None, asked: np.ndarray | None = None):
        """``flag``: an array to be used again; ``asked``: whether flags are asked for an n-gram, by default for all."""
        name = _gram_hash(sign)
        self.flag = np.empty(1 << FLAGS, bool) if flag is None else flag
        self.flag.fill(False)
        at = np.arange(len(name)) if asked is None else np.flatnonzero(asked.take(name))
        place = _flag(name[at], at)
        # A flag tells of a stretch and the next one, so every other one is asked for.
        for k in range(2):
            self.flag[(place - np.uint32(k) * _A32) & _FLAG] = True
        self.sorted = name.astype(np.int64)
        self.sorted <<= PLACE
        self.sorted += np.arange(len(name))
        self.sorted.sort()

    def flagged(self, name: np.ndarray, low: np.ndarray, steps: int) -> np.ndarray:
        """Whether each n-gram may begin in the ``steps`` stretches from that of ``low`` on."""
        if steps > STRETCHES:
            return np.ones(name.shape, bool)
        at = _flag(name, low)
        out = self.flag.take(at & _FLAG)
        for k in range(2, steps, 2):
            out |= self.flag.take((at + np.uint32(k * int(_A32) & 0xFFFFFFFF)) & _FLAG)
        return out

    def stands(self, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each n-gram begins somewhere in low..high."""
        if not len(self.sorted):
            return np.zeros(len(name), bool)
        name = name.astype(np.int64) << PLACE
        at = np.searchsorted(self.sorted, name + low)
        return (at < len(self.sorted)) & (self.sorted.take(at, mode="clip") <= name + high)


def _flag(name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number, in its lower bits, of the flag of each n-gram in the stretch of a place."""
    out = (at >> STRETCH).astype(np.int32).view(np.uint32)
    out *= _A32
    out += name
    return out


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the stretch and place, for each place of the stretches."""
    first = np.cumsum(size) - size
    k = np.repeat(np.arange(len(size)), size)
    return k, np.arange(len(k)) + (begin - first)[k]


_SYMBOL = np.where(np.arange(256) >= 0x80, 0x80, np.where(_SEP, 0x20, _LOWER)).astype(np.uint8)


def symbols(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised text, one byte a character, all characters above 0x7F alike; and the places of its characters in ``data``."""
    apart = _SEP[data]
    keep = (data & 0xC0) != 0x80
    keep[1:] &= ~(apart[1:] & apart[:-1])
    at = np.flatnonzero(keep)
    return _SYMBOL[data[at]], at


def _gram_hash(s: np.ndarray) -> np.ndarray:
    if len(s) < GRAM:
        return np.zeros(0, np.uint32)
    x = np.zeros(len(s) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        x = (x ^ s[k : len(s) - GRAM + 1 + k]) * _A32
        x ^= x >> np.uint32(15)
    return x >> np.uint32(32 - NAME)


def anchors(flat: np.ndarray, spacing: int = SPACING) -> np.ndarray:
    """Positions whose hash of two words is the least of some ``spacing`` neighbouring ones (ties: all)."""
    if len(flat) <= spacing:
        return np.arange(len(flat))
    h = mix(flat ^ (np.concatenate([flat[1:], flat[:1]]) * _A))
    view = np.lib.stride_tricks.sliding_window_view(h, spacing).min(1) if len(h) < 1 << 10 else _running_min(h, spacing)
    mark = np.zeros(len(h), bool)
    for k in range(spacing):
        mark[k : k + len(view)] |= h[k : k + len(view)] == view
    return np.flatnonzero(mark)


def _running_min(h: np.ndarray, n: int) -> np.ndarray:
    size = len(h) - n + 1
    return reduce(np.minimum, (h[k : k + size] for k in range(n)))


def leaks_in(texts: pa.Array, ix: Index) -> dict[tuple[int, int], int]:
    """Edits by (row, item) of the leaks in a column of texts."""
    data, off = string_bytes(pc.utf8_lower(texts))
    leaks: dict[tuple[int, int], int] = {}
    if not ix.items:
        return leaks
    flag = np.empty(1 << FLAGS, bool)
    for i, j in slices(off, SLICE):
        w = words(data, off, i, j, _SEP, _LOWER)
        if not len(w.hash):
            continue
        base, tried = int(off[i]), set()
        here = data[base : int(off[j])]
        sign, place = symbols(here)
        grams, edge = Grams(sign, flag, ix.asked), np.searchsorted(place, off[i : j + 1] - base)
        word = np.searchsorted(place, w.start)
        raw = here.tobytes()
        for p, item, o in ix.candidates(w.hash):
            row = np.searchsorted(w.first, p, "right") - 1
            grid = ix.most[item] // 2 + 4
            # Where the item would begin, in steps of the edits it may have.
            step = (word[p] - ix.before[ix.word_of[item] + o]) // grid
            low, wide = step.min(), int(step.max() - step.min()) + 1
            cell = np.unique((row * len(ix.items) + item) * wide + step - low)
            row, item, step = cell // (wide * len(ix.items)), cell // wide % len(ix.items), cell % wide + low
            grid, most = ix.most[item] // 2 + 4, ix.most[item]
            begin = np.maximum(edge[row], step * grid - most)
            end = np.minimum(edge[row + 1], (step + 1) * grid + ix.n_chars[item] + most)
            good = ix.may_match(grams, item, step * grid, grid, edge[row], edge[row + 1])
            for r, k, c, x, y in np.stack([row, item, step, begin, end], 1)[good].tolist():
                if (r, k, c) in tried or leaks.get((i + r, k)) == 0:
                    continue
                tried.add((r, k, c))
                passage = squash(raw[place[x] : place[y] if y < len(place) else len(raw)].decode("utf-8", "replace"))
                most = int(ix.most[k])
                d = edit_distance(ix.items[k][1], passage)
                if d <= most and d < leaks.get((i + r, k), 1 << 30):
                    leaks[i + r, k] = d
    return leaks


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        for batch in batches:
            leaks = leaks_in(batch.column("text"), ix)
            rows = [row for row, _ in leaks]
            out = [(ix.items[k][0], d, len(ix.items[k][1])) for (_, k), d in leaks.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], ["id", "item_id", "edits", "item_chars"])

    return map_batches(docs, run, f"id {kind}, item_id long, edits long, item_chars long")


def _items(benchmark: DataFrame, item_column: str, item_text: str, named: bool = True) -> DataFrame:
    return benchmark.where(F.col(item_column).isNotNull() if named else F.lit(True)).select(F.col(item_column).cast("long").alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text")).distinct()


def remove_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, items without an id included, with all their columns, whatever their names.

    Every row is judged by its own text, so repeated rows go or stay together; null and empty texts stay, texts of any length
    are read whole. Without items all rows stay; an empty table gives no rows.
    """

    def without(df: DataFrame, index: Index) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in leaks_in(batch.column(text_column), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        return map_batches(df, run, df.schema)

    for rows in _blocks(_items(benchmark, item_column, item_text, named=False), block):
        docs = without(docs, Index(rows, max_edit))
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, item_id, edits, item_chars) for each row and item where a passage of the text is within
    ``max_edit`` edits per character of the item, both normalised.

    Items without words or without an id match nothing here; items that repeat count once. Null texts are empty, ids of rows may
    be null, texts of any length are read whole, and a row that repeats gives its pairs again. Of several passages the least
    edits count. Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = None
    for rows in _blocks(_items(benchmark, item_column, item_text), block):
        found = _scan(base, Index(rows, max_edit))
        out = found if out is None else out.unionByName(found)
    kind = base.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"id {kind}, item_id long, edits long, item_chars long") if out is None else out
    return out.withColumnRenamed("id", id_column)


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded count and bytes, streamed through the driver one partition at a time."""
    held, size = [], 0
    for r in items.sortWithinPartitions("item_id", "text").toLocalIterator():
        if held and (len(held) >= block or size + len(r.text) > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that leak into them."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
