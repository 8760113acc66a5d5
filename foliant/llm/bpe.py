"""BPE encoding and decoding by tree concatenation.

A text longer than ``LEAF`` characters is cut in halves, each half is encoded on its own, and a growing
window around the join is encoded anew until its ends agree with both sides:

* at the level of the pre-tokenizer the window reaches to cuts where the pattern splits whatever stands
  around them (a letter before a digit or a space, a space after anything but a space, and so on); from
  such a cut on, left-to-right matching is the same in the window, in the half and in the whole text;
* where a run of one character class is longer than the window (unsplit text), tokens are compared
  instead: a sequence is the encoding of its bytes exactly if each neighbouring pair of tokens encodes to
  itself, so a window of k tokens on either side is encoded anew and k doubles until the pairs at both
  its seams do.

Strings of added tokens in a text become those tokens, as in the tokenizers library, and never lie
across a join. Texts above ``SEGMENT`` characters are cut into segments that separate tasks encode and
one task per text joins; equal long texts are encoded once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.llm.work import map_batches, tasks

LEAF, SEGMENT, WINDOW, RUN = 2048, 1 << 16, 48, 512
_CLASSES = regex.compile(r"(\p{L})|(\p{N})|(\s)")
#: Class before and after a cut where the pre-tokenizer's pattern always splits: letter, number, space, other.
_SAFE = {"LN", "NL", "LS", "NS", "OS", "LO", "NO", "ON"}


def _byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, run: int = RUN):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        if any(vocab["".join(m.split(" ") if isinstance(m, str) else m)] != 256 + k for k, m in enumerate(spec["model"]["merges"])):
            raise ValueError("the ids of merged tokens do not follow the merges")
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.added.items()}
        self.leaf, self.window, self.run = leaf, window, run
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._pair = lru_cache(1 << 16)(lambda a, b: self.enc._encode_single_piece(self.piece[a] + self.piece[b]) == [a, b])

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, string) in order."""
        at = 0
        for m in self.special.finditer(text) if self.special and any(t in text for t in self.added) else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for added, part in self.parts(text):
            out += [self.added[part]] if added else self.tree(part)
        return out

    def tree(self, text: str) -> list[int]:
        """Encodes a text without added tokens."""
        if len(text) <= self.leaf:
            return self.enc.encode_ordinary(text)
        mid = len(text) // 2
        return self.join(text, mid, self.tree(text[:mid]), self.tree(text[mid:]))

    def _class(self, c: str) -> str:
        m = _CLASSES.match(c)
        return "LNS"[m.lastindex - 1] if m else "O"

    def _cut(self, text: str, places: range) -> int | None:
        """The first of the places where the pattern always splits."""
        for k in places:
            if k <= 0 or k >= len(text):
                return max(0, min(k, len(text)))
            if self._class(text[k - 1]) + self._class(text[k]) in _SAFE:
                return k
        return None

    def join(self, text: str, mid: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of ``text`` from those of text[:mid] and text[mid:]."""
        w, start, stop = self.window, None, None
        done_l, done_r = mid, mid
        while start is None or stop is None:
            if start is None:
                start = self._cut(text, range(done_l - 1, max(0, mid - w) - 1, -1))
                done_l = max(0, mid - w)
            if stop is None:
                stop = self._cut(text, range(done_r + 1, min(len(text), mid + w) + 1))
                done_r = min(len(text), mid + w)
            if (start is None or stop is None) and w >= self.run:
                merged = self._join_run(text, mid, left, right)
                if merged is not None:
                    return merged
            w *= 2
        return self._splice(left, right, len(text[start:mid].encode()), len(text[mid:stop].encode()), self._plain(text[start:stop]))

    def _plain(self, text: str) -> list[int]:
        """Encodes a window; a long one holds a run, whose pieces are encoded by halves."""
        if len(text) <= 2 * self.run:
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        for m in regex.finditer(self.enc._pat_str, text):
            out += self._halves(m[0].encode())
        return out

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) <= self.run:
            return self.enc._encode_single_piece(piece)
        mid = len(piece) // 2
        left, right = self._halves(piece[:mid]), self._halves(piece[mid:])
        k = 4
        while True:
            merged = self._seams(left, right, k)
            if merged is not None:
                return merged
            if k >= len(left) and k >= len(right):
                return self.enc._encode_single_piece(piece)
            k *= 2

    def _seams(self, left: list[int], right: list[int], k: int) -> list[int] | None:
        a, b = max(0, len(left) - k), min(len(right), k)
        window = self.enc._encode_single_piece(b"".join(self.piece[t] for t in left[a:] + right[:b]))
        if (a == 0 or self._pair(left[a - 1], window[0])) and (b == len(right) or self._pair(window[-1], right[b])):
            return left[:a] + window + right[b:]
        return None

    def _join_run(self, text: str, mid: int, left: list[int], right: list[int]) -> list[int] | None:
        """Joins inside a run of one class that reaches over the whole window, or None if it is not one."""
        room = self.run // 2
        around = text[mid - room : mid + room]
        kinds = {self._class(c) for c in around}
        if len(around) < 2 * room or len(kinds) > 1:
            return None
        before, after = len(text[mid - room : mid].encode()), len(text[mid : mid + room].encode())
        k = 4
        while True:
            a, b = left[max(0, len(left) - k - 1) :], right[: k + 1]
            if sum(len(self.piece[t]) for t in a) >= before or sum(len(self.piece[t]) for t in b) >= after:
                return None
            merged = self._seams(left, right, k)
            if merged is not None:
                return merged
            k *= 2

    def _splice(self, left: list[int], right: list[int], back: int, ahead: int, window: list[int]) -> list[int]:
        a, b = len(left), 0
        while back > 0:
            a -= 1
            back -= len(self.piece[left[a]])
        while ahead > 0:
            ahead -= len(self.piece[right[b]])
            b += 1
        if back or ahead:
            raise AssertionError("a cut of the pre-tokenizer is not a token boundary")
        return left[:a] + window + right[b:]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def segments(self, text: str, size: int = SEGMENT) -> Iterator[tuple[bool, str]]:
        """Like parts(), with long parts cut into segments of ``size``."""
        for added, part in self.parts(text):
            for k in range(0, len(part), size):
                yield added, part[k : k + size]

    def join_segments(self, segments: list[tuple[bool, str, list[int]]]) -> list[int]:
        """Joins neighbours pairwise, level by level."""
        done: list[int] = []
        group: list[tuple[str, list[int]]] = []

        def close():
            nonlocal group
            while len(group) > 1:
                group = [(a[0] + b[0], self.join(a[0] + b[0], len(a[0]), a[1], b[1])) if b else a for a, b in zip(group[::2], [*group[1::2], None], strict=False)]
            if group:
                done.extend(group[0][1])
            group = []

        for added, text, ids in segments:
            if added:
                close()
                done.extend(ids)
            else:
                group.append((text, ids))
        close()
        return done


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _row(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, with_columns: bool = False, segment: int = SEGMENT) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) per row, ``with_columns`` after the other columns of docs but the text.

    A null text is empty and an empty text has no ids. Rows repeat as in the input, ids may be null, long texts are encoded by
    segments, equal long ones once. A column of docs that bears the name of a result is left out, all others may have any
    names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = {id_column, text_column, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])}
    more = [c for c in docs.columns if c not in own] if with_columns else []
    base = docs.select(F.struct(F.col(f"`{id_column}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(more)]).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    fields, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names, types = fields + ["ids"] * with_ids, kinds + [pa.list_(pa.int32())] * with_ids

    def row(c: Codec, ids: list[int]) -> tuple:
        return (*_row(c, ids), *([ids] if with_ids else []))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = [row(c, c.encode(t)) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(v, t) for v, t in zip(columns, types, strict=True)]], ["id", *names])

    kind = StructType([base.schema["id"], *StructType.fromDDL(schema)])
    short = map_batches(base.where(F.length("text") <= segment), whole, kind)
    long = base.where(F.length("text") > segment).withColumn("key", F.sha2("text", 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, (added, part) in enumerate(c.segments(text, segment)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int64()), pa.array([added]), pa.array([part])], ["key", "no", "added", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.array(c.encode(t) if a else c.tree(t), "<i4").tobytes() for a, t in zip(batch.column("added").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, "ids"])

    def meet(group: pa.Table) -> pa.Table:
        c, group = codec(path), group.sort_by("no")
        ids = [np.frombuffer(x, "<i4").tolist() for x in group.column("ids").to_pylist()]
        found = row(c, c.join_segments(list(zip(group.column("added").to_pylist(), group.column("part").to_pylist(), ids, strict=True))))
        return pa.table([pa.array([group.column("key")[0].as_py()]), *[pa.array([v], t) for v, t in zip(found, types, strict=True)]], ["key", *names])

    distinct = long.groupBy("key").agg(F.first("text").alias("text"))
    pieces = map_batches(map_batches(distinct, cut, "key string, no long, added boolean, part string").repartition(tasks(spark), "key", "no"), encode, "key string, no long, added boolean, part string, ids binary")
    joined = pieces.groupBy("key").applyInArrow(meet, f"key string, {schema}")
    out = short.unionByName(long.select("id", "key").join(joined, "key").select("id", *names))
    return out.select(F.col("id.id").alias(id_column), *[F.col(f"id.c{k}").alias(c) for k, c in enumerate(more)], *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    import public_tokenizers

    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
