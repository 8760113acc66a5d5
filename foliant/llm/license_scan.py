"""License scans: Dice coefficient over word bigrams between licence templates and passages of a text.

Texts and templates are normalised alike: A-Z lower-cased, words are runs of letters, digits and bytes
above 0x7F. For a template of m bigrams only passages of m*t/(2-t) to m*(2-t)/t bigrams can reach a Dice
coefficient t, and they must share at least m*t/(2-t) bigrams with it; both bounds prune candidates before any
coefficient is computed. A text's bigrams are first looked up in the templates' small table, so running
text costs one lookup a word. A passage must also hold the word pairs that its template needs, such as those of a
version. For each template a text is read once: of the passages that begin before the best one so far ends
the best is kept, and reading goes on behind it, so time and memory follow the text's length however many copies it holds.
Of the passages of all templates the best that do not overlap are given, ties to the longer template. Whole texts are scanned,
and no row depends on another.

A one-word template is compared as that word. Null, empty and one-word texts match nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.license_texts import TEMPLATES
from foliant.llm.tokens import _LOWER, mix, slices, string_bytes, words
from foliant.llm.work import map_batches

THRESHOLD = 0.8
_SEP = np.ones(256, bool)
_SEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_A = np.uint64(0xD6E8FEB86659FD93)


def bigrams(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) < 2:
        return hashes.copy()
    return mix(hashes[:-1] * _A + hashes[1:])


class Matcher:
    """Templates as bigram multisets, and the search for their passages in a text's bigrams."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.t, self.names, self.bags, self.needs = threshold, [], [], []
        for name, text, *needs in templates:
            self.names.append(name)
            self.bags.append(Counter(self._bigrams(text).tolist()))
            self.needs.append(self._bigrams(needs[0]) if needs and needs[0] else np.zeros(0, np.uint64))
        self.sizes = [sum(b.values()) for b in self.bags]
        self.low = [m * threshold / (2 - threshold) for m in self.sizes]
        self.high = [m * (2 - threshold) / threshold for m in self.sizes]
        keys = sorted({k for b in self.bags for k in b})
        self.limit = [np.zeros(len(keys), np.int64) for _ in self.bags]
        self.keys = np.array(keys, np.uint64)
        self.member = np.zeros((len(keys), len(self.bags)), bool)
        for t, bag in enumerate(self.bags):
            at = np.searchsorted(self.keys, np.array(list(bag), np.uint64))
            self.member[at, t] = True
            self.limit[t][at] = list(bag.values())
            self.needs[t] = np.searchsorted(self.keys, self.needs[t][np.isin(self.needs[t], self.keys)])
        self.flag = np.zeros(1 << 16, bool)
        self.flag[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def _bigrams(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return bigrams(words(data, np.array([0, len(data)]), 0, 1, _SEP, _LOWER).hash)

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of bigrams that some template has, and which of the keys each is."""
        at = np.flatnonzero(self.flag[(x & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        same = self.keys[k] == x[at]
        return at[same], k[same]

    def best(self, at: np.ndarray, key: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(dice, template, first bigram, bigrams) of the best passages that do not overlap."""
        found = [hit for t in range(len(self.bags)) for hit in self._passages(t, at, key)]
        found.sort(key=lambda x: (-x[0], -self.sizes[x[1]], x[1], x[2], x[3]))
        kept: list[tuple[float, int, int, int]] = []
        taken = np.zeros(max((b + n for _, _, b, n in found), default=0) + 1, bool)
        for hit in found:
            words_of = slice(hit[2], hit[2] + hit[3] + 1)
            if not taken[words_of].any():
                taken[words_of] = True
                kept.append(hit)
        return sorted(kept, key=lambda x: x[2])

    def _passages(self, t: int, at: np.ndarray, key: np.ndarray) -> Iterator[tuple[float, int, int, int]]:
        """Passages of one template, none within another."""
        mine = self.member[key, t] if len(key) else np.zeros(0, bool)
        p, k = at[mine], key[mine]
        if len(p) < max(1, self.low[t] - 1e-9):
            return
        reach = np.searchsorted(p, p + self.high[t] + 1e-9, "left")
        starts = np.flatnonzero(reach - np.arange(len(p)) >= self.low[t] - 1e-9)
        if not len(starts):
            return
        # Of each bigram, how many stand before each place; a passage counts it as often as the template has it.
        order = np.argsort(k, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(k[order]) != 0))
        rank = np.empty(len(k), np.int64)
        rank[order] = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
        before, most = np.zeros(len(self.keys), np.int64), self.limit[t]
        best, end, done = None, -1, 0
        for i in starts.tolist():
            if best and p[i] > end:
                yield best
                best = None
            if not best and p[i] <= end:
                # The rest of a passage that was given.
                continue
            before[k[done:i]] = np.maximum(before[k[done:i]], rank[done:i] + 1)
            done = i
            own = slice(i, reach[i])
            shared = np.cumsum(rank[own] - before[k[own]] < most[k[own]])
            size = p[own] - p[i] + 1
            dice = 2 * shared / (size + self.sizes[t])
            for need in self.needs[t].tolist():
                there = np.flatnonzero(k[own] == need)
                dice[: there[0] if len(there) else len(dice)] = 0
            dice[size > self.high[t] + 1e-9] = 0
            j = int(np.argmax(dice))
            if dice[j] >= self.t - 1e-12 and (best is None or dice[j] > best[0]):
                best = (float(dice[j]), t, int(p[i]), int(size[j]))
                end = int(p[i] + size[j])
        if best:
            yield best


#: Templates of a table, and their characters, up to which they fit a task.
MAX_TEMPLATES, MAX_TEMPLATE_CHARS = 5_000, 64 << 20


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, license_id, dice, first_word, n_words, passage) for each passage found, in whole texts.

    ``templates`` are tuples (id, text, needs) or a table (license_id, text, needs) of checked size. Null and empty texts
    have no passage, texts of any length are read whole, ids may be null, repeated rows give their passages each; of
    templates that fit alike the longer wins, then the one that stands first. Other columns, whatever their names, are not
    read. An empty table gives no rows.
    """
    if isinstance(templates, DataFrame):
        size = templates.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
        if size.n > MAX_TEMPLATES or (size.chars or 0) > MAX_TEMPLATE_CHARS:
            raise ValueError("too many templates for a task; scan with parts of the table")
        templates = tuple((r.license_id, r.text, r.needs or "") for r in templates.where("text <> ''").orderBy("license_id", "text").collect())
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)  # some milliseconds a task
        for batch in batches:
            data, off = string_bytes(batch.column("text"))
            rows, out = [], []
            for i, j in slices(off):
                w = words(data, off, i, j, _SEP, _LOWER)
                if not len(w.hash):
                    continue
                x = bigrams(w.hash) if len(w.hash) > 1 else w.hash
                at, key = matcher.hits(x)
                last = w.first[1:] - 1
                spans = np.isin(at, last[:-1], assume_unique=False) & (len(w.hash) > 1)
                at, key = at[~spans], key[~spans]
                cut = np.searchsorted(at, w.first)
                for k in np.flatnonzero(np.diff(cut)):
                    lo, hi = cut[k], cut[k + 1]
                    for dice, t, b, n in matcher.best(at[lo:hi], key[lo:hi]):
                        begin, end = int(off[i]) + int(w.start[b]), int(off[i]) + int(w.end[min(b + n, len(w.end) - 1)])
                        rows.append(i + k)
                        out.append((matcher.names[t], dice, b - int(w.first[k]), n + 1, data[begin:end].tobytes().decode("utf-8", "replace")))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], ["id", "license_id", "dice", "first_word", "n_words", "passage"])

    return map_batches(base, run, f"id {kind}, license_id string, dice double, first_word long, n_words long, passage string").withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence passages in every whole text of ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("dice", F.round("dice", 9))
