"""Vectorised word and shingle hashing over Arrow string buffers.

Words are runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased, which on UTF-8 is the same
as the pattern ``[^\\x20\\x09-\\x0D]+`` on characters. Words and shingles are represented by 64-bit
hashes; a null text counts as empty. Texts are handled in slices of about ``SLICE`` bytes, so memory
follows the slice or the one longest text (some 60 bytes per byte of it), never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _A = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _P, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of rows i..j: hashes, and where each row's words begin (``first`` has one entry more than rows)."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, off: np.ndarray, i: int, j: int, sep: np.ndarray = _SEP, fold: np.ndarray = _LOWER) -> Words:
    base = int(off[i])
    b = data[base : int(off[j])]
    o = (off[i : j + 1] - base).astype(np.int64)
    if not len(b):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64), z, z)
    inside = ~sep[b]
    prev = np.empty(len(b), bool)
    prev[0], prev[1:] = False, inside[:-1]
    edges = o[:-1][o[:-1] < len(b)]
    prev[edges] = False
    start = np.flatnonzero(inside & ~prev)
    after = np.empty(len(b), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = o[1:][o[1:] > 0] - 1
    after[ends] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, o)
    if not len(start):
        return Words(np.zeros(0, np.uint64), first, start, end)
    length = end - start
    packed = fold[b[inside]].astype(np.uint64)
    at = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=at[1:])
    place = np.arange(len(packed)) - np.repeat(at, length)
    sums = np.add.reduceat((packed + np.uint64(1)) * _power(int(length.max()) + 1)[place], at)
    return Words(mix(sums ^ (length.astype(np.uint64) * _A)), first, start, end)


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their row numbers; a row of 1..n-1 words gives one of them all."""
    rows, counts = len(w.first) - 1, w.counts
    row = np.repeat(np.arange(rows), counts)
    m = len(w.hash)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.zeros(max(0, m - n + 1), np.uint64)
    for k in range(n):
        x = x * _A + w.hash[k : k + len(x)]
    whole = row[: len(x)] == row[n - 1 :] if len(x) else np.zeros(0, bool)
    out, at = mix(x[whole] + np.uint64(n)), row[: len(x)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for v in w.hash[w.first[r] : w.first[r + 1]]:
                    h = h * _A + v
                h += np.uint64(counts[r])
            extra[k] = h
        out, at = np.concatenate([out, mix(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def shingle_sets(col: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row in order."""
    data, off = string_bytes(col)
    for i, j in slices(off):
        x, at = shingles(words(data, off, i, j), n)
        cut = np.searchsorted(at, np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, np.unique(x[cut[k] : cut[k + 1]])
