"""Chunking: documents into pieces of bounded token counts.

Whether a paragraph opens a new chunk depends on all that came before it in its document, so each
document is folded in order. A fold is linear in the text and needs no other document, so tasks stream
through batches of documents; nothing is shuffled, and a chunk id counts within its document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from foliant.functions.text import COMPLETE_ENDS, CONJUNCTIONS, HEADING, INCOMPLETE_ENDS

_HEADING = regex.compile(HEADING.replace("^(?:", "^(?:", 1), regex.IGNORECASE | regex.MULTILINE)
_CJK = regex.compile(r"[一-鿿぀-ゟ゠-ヿ가-힯]")
_SPACE = regex.compile(r"\s")
_MARK = regex.compile(r"[^\p{L}\p{N}\s]")
#: Opening marks of speech and what closes them, and marks that end a sentence.
QUOTES = {'"': '"', "'": "'", "「": "」", "『": "』", "《": "》", "“": "”", "”": "“", "‘": "’", "’": "‘"}
SENTENCE_ENDS = frozenset(".!?。！？")
AFTER_END = frozenset('"”»」')


@lru_cache(1)
def _quarters() -> np.ndarray:
    """Quarter tokens of each code point: CJK 4, marks 2, white space and all other 1."""
    out = np.ones(0x110000, np.uint8)
    plain = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, weight in ((_MARK, 2), (_SPACE, 1), (_CJK, 4)):
        out[np.frombuffer("".join(pattern.findall(plain)).encode("utf-32-le"), np.uint32)] = weight
    return out


def weighted_tokens(text: str) -> int:
    """CJK 1, marks 1/2, white space 1/4, other 1/4 a character; at least 1, 0 for no text."""
    if not text:
        return 0
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return max(1, int(_quarters()[points].sum(dtype=np.int64)) // 4)


@dataclass
class Piece:
    text: str
    tokens: int
    kind: str


@dataclass
class Chunker:
    """Rules and limits of a chunker; ``count`` is the token counter."""

    limit: int
    count: Callable[[str], int] = weighted_tokens
    min_utilization: float = 0.5
    small_last: bool = True
    balance: bool = True

    def paragraphs(self, text: str) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        for line in text.split("\n"):
            if line.strip():
                held.append(line)
                continue
            if held:
                out.append("\n".join(held))
                held = []
            out.append("")
        return [*out, "\n".join(held)] if held else out

    @staticmethod
    def glue(parts: list[str]) -> str:
        return "\n".join(p.strip() for p in parts)

    @staticmethod
    def incomplete(paragraph: str) -> bool:
        own = paragraph.strip()
        if not own or own[-1] in COMPLETE_ENDS:
            return False
        return own[-1] in INCOMPLETE_ENDS or len(own) < 30 or own.lower().endswith(CONJUNCTIONS)

    @staticmethod
    def sentences(text: str) -> list[str]:
        """Cuts after an end mark that stands outside speech and before white space, a closing mark or the end."""
        out, start, close = [], 0, None
        for k, c in enumerate(text):
            if close is None and c in QUOTES:
                close = QUOTES[c]
            elif c == close:
                close = None
            if close is None and c in SENTENCE_ENDS and (k + 1 == len(text) or text[k + 1].isspace() or text[k + 1] in AFTER_END):
                out.append(text[start : k + 1].strip())
                start = k + 1
        return [s for s in [*out, text[start:].strip()] if s]

    def hard_split(self, text: str) -> list[str]:
        """Longest fitting prefixes; what is left loses its leading white space."""
        rest, out = text.strip(), []
        while rest:
            # A prefix that does not fit bounds the search, so what is left is not counted for each piece.
            hi = min(len(rest), 2 * self.limit)
            while self.count(rest[:hi]) <= self.limit:
                if hi == len(rest):
                    return [*out, rest]
                hi = min(len(rest), 2 * hi)
            lo = 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if self.count(rest[:mid]) <= self.limit else (lo, mid - 1)
            out.append(rest[:lo])
            rest = rest[lo:] if self.count(rest[:lo]) > self.limit else rest[lo:].lstrip()
        return out

    def _units(self, paragraph: str, size: int) -> Iterator[tuple[str, int, bool]]:
        """(unit, its size, whether it comes from a paragraph too long to stay whole)."""
        if size <= self.limit:
            yield paragraph, size, False
            return
        for s in self.sentences(paragraph) or [paragraph]:
            own = self.count(s)
            if own <= self.limit:
                yield s, own, True
            else:
                for unit in self.hard_split(s):
                    yield unit, self.count(unit), True

    def pack(self, text: str) -> list[Piece]:
        """Greedy packing of paragraphs.

        One that would overflow the chunk opens a new one, unless it or the last is cut short and it has
        at most 0.4 of the limit. A paragraph over the limit closes the chunk and comes in sentences.
        """
        out: list[Piece] = []
        held: list[str] = []
        tokens = 0

        def close(last: bool = False):
            nonlocal held, tokens
            if held:
                joined = self.glue(held)
                if joined.strip() or not last:
                    out.append(Piece(joined, self.count(joined), "paragraph_split"))
            held, tokens = [], 0

        for paragraph in self.paragraphs(text):
            own = self.count(paragraph)
            if own > self.limit:
                close()
            for unit, size, split in self._units(paragraph, own):
                if held and tokens + size > self.limit:
                    stretch = not split and size <= self.limit * 0.4 and (self.incomplete(held[-1]) or self.incomplete(unit))
                    if not stretch:
                        close()
                held.append(unit)
                tokens += size
        close(last=True)
        return out

    def chapters(self, text: str) -> list[tuple[str, str]]:
        """(title, text) from one heading to the next; what stands before the first is Intro."""
        starts = [m.start() for m in _HEADING.finditer(text)]
        if not starts:
            return [("Intro", text)]
        out = [("Intro", text[: starts[0]])] if text[: starts[0]].strip() else []
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            out.append((text[a:b].split("\n", 1)[0].strip(), text[a:b]))
        return out

    def hybrid(self, text: str) -> list[Piece]:
        """Front matter and first chapter together up to 1.5 limits; other chapters whole if they fit, else packed."""
        if not text or not text.strip():
            return []
        parts = self.chapters(text)
        first = next((k for k, (title, _) in enumerate(parts) if "Intro" not in title), -1)
        out: list[Piece] = []
        if first >= 0:
            joined = "\n\n".join(t for _, t in parts[: first + 1])
            size = self.count(joined)
            out += [Piece(joined, size, "hybrid_chapter_merge")] if size <= self.limit * 1.5 else self.pack(joined)
        for _, chapter in parts[first + 1 :]:
            size = self.count(chapter)
            out += [Piece(chapter, size, "hybrid_chapter_full")] if size <= self.limit else self.pack(chapter)
        return self.cap(self.balanced(out)) if self.balance and len(out) > 1 else out

    def balanced(self, pieces: list[Piece]) -> list[Piece]:
        """Pieces under the least use wait and join the next ones, up to 1.5 limits."""
        least, soft = int(self.limit * self.min_utilization), self.limit * 1.5
        out: list[Piece] = []
        held: list[str] = []
        tokens = 0

        def new(text: str) -> Piece:
            return Piece(text, self.count(text), "paragraph_split")

        def flush():
            nonlocal held, tokens
            if held:
                out.append(new("\n\n".join(held)))
            held, tokens = [], 0

        for p in pieces:
            size = p.tokens
            if size < least:
                held.append(p.text)
                tokens += size
                if tokens >= least:
                    flush()
            elif size <= self.limit:
                if held and tokens + size <= soft:
                    held.append(p.text)
                    flush()
                else:
                    flush()
                    out.append(Piece(p.text, size, "paragraph_split"))
            else:
                flush()
                out += self.pack(p.text)
        if held:
            if out and self.small_last and out[-1].tokens + tokens <= soft:
                out[-1] = new("\n\n".join([out[-1].text, *held]))
            else:
                flush()
        return out

    def cap(self, pieces: list[Piece]) -> list[Piece]:
        return [q for p in pieces for q in ([p] if p.tokens <= self.limit else self.pack(p.text))]

    def by_blocks(self, blocks: list[tuple[str, str]]) -> list[Piece]:
        """(type, text) blocks: a heading opens a section; sections over the limit are packed."""
        sections: list[list[str]] = []
        for kind, text in blocks:
            text = (text or "").strip()
            if not text:
                continue
            if kind == "heading" or not sections:
                sections.append([])
            sections[-1].append(text)
        out: list[Piece] = []
        for s in sections:
            joined = "\n".join(s).strip()
            size = self.count(joined)
            out += [Piece(joined, size, "paragraph_split")] if size <= self.limit else self.pack(joined)
        return self.cap(out)


def pack_entries(sizes: list[int], limit: int) -> list[int]:
    """1-based chunk of each entry: consecutive entries whose sizes sum to at most ``limit``; one may exceed it alone."""
    out, chunk, total = [], 1, None
    for n in sizes:
        if total is not None and total + n > limit:
            chunk, total = chunk + 1, 0
        total = (total or 0) + n
        out.append(chunk)
    return out


#: Texts whose pieces are held at a time.
FOLDED_ROWS = 512


def fold_documents(docs: DataFrame, fold: Callable[[str], list[tuple]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ...) from a function of one text; ``schema`` names what follows the key. Null texts give no rows."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *[c.split()[0] for c in schema.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # In parts, so that pieces of many long texts do not pile up.
            for lo in range(0, max(1, len(frame)), FOLDED_ROWS):
                part = frame.iloc[lo : lo + FOLDED_ROWS]
                rows = [(k, *row) for k, t in zip(part[key], part[text], strict=True) if t is not None for row in fold(t)]
                yield pd.DataFrame(rows, columns=names)

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, {schema}")


def chunk_documents(docs: DataFrame, chunker: Chunker, method: str = "hybrid", key: str = "doc_id") -> DataFrame:
    """(key, chunk_id, tokens, kind, text): chunk ids count from 0 within a document."""
    schema = "chunk_id bigint, tokens bigint, kind string, text string"
    return fold_documents(docs, lambda t: [(k, p.tokens, p.kind, p.text) for k, p in enumerate(getattr(chunker, method)(t))], schema, key)
