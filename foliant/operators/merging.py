"""Ordered re-merging of processed chunks: overlap removal, marker checks and paragraph repair."""

from __future__ import annotations

import re

_SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]?")
_WORD = re.compile(r"\w+")


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the sets of words."""
    x, y = set(_WORD.findall(a.lower())), set(_WORD.findall(b.lower()))
    return len(x & y) / len(x | y) if x | y else 0.0


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.findall(text) if s.strip()]


def overlap(previous: str, current: str, sentence_limit: float = 0.75, paragraph_limit: float = 0.8) -> int:
    """How many leading characters of ``current`` repeat the end of ``previous``.

    One to three boundary sentences that are alike count, the most first; else a first paragraph like the last 200 characters.
    """
    tail, head = sentences(previous), sentences(current)
    for n in (3, 2, 1):
        if len(tail) >= n and len(head) >= n and similarity(" ".join(tail[-n:]), " ".join(head[:n])) > sentence_limit:
            at = 0
            for s in head[:n]:
                at = current.index(s, at) + len(s)
            return at
    first = current.split("\n\n", 1)[0]
    if len(current) > len(first) and similarity(previous[-200:], first[:200]) > paragraph_limit:
        return len(first)
    return 0


def merge_without_overlap(parts: list[str]) -> str:
    """Parts in order, each without what repeats the end of the last part kept."""
    kept: list[str] = []
    for p in parts:
        if kept:
            p = p[overlap(kept[-1], p) :].lstrip()
        if p.strip():
            kept.append(p)
    return "\n\n".join(kept)


def marker_problem(text: str, chunk_id: int) -> str | None:
    """Why the markers of a chunk are wrong: any count but one of each, or none at all, is."""
    counts = tuple(len(re.findall(rf"\[CHUNK:{chunk_id}:{m}\]", text)) for m in ("START", "END"))
    return None if counts in ((0, 0), (1, 1)) else f"start {counts[0]}, end {counts[1]}"


def repair_markers(text: str, chunk_id: int) -> str:
    """Keeps the first START and the last END."""
    start, end = f"[CHUNK:{chunk_id}:START]", f"[CHUNK:{chunk_id}:END]"
    if text.count(start) > 1:
        head, _, rest = text.partition(start)
        text = head + start + rest.replace(start, "")
    if text.count(end) > 1:
        rest, _, tail = text.rpartition(end)
        text = rest.replace(end, "") + end + tail
    return text


def merge_paragraphs(parts: list[str], ends: str = '.!?。！？"”’」』》…:') -> str:
    """Parts in order; a paragraph without an end mark and a lower-case start after it are one."""
    out = ""
    for p in parts:
        p = p.strip()
        if not p:
            continue
        if not out:
            out = p
        elif out[-1] not in ends and p[0].islower():
            out += " " + p
        else:
            out += "\n\n" + p
    return out


def rejoin_lines(text: str, ends: str = ".!?。！？:;\"”」』") -> str:
    """Scanned lines that break inside a sentence are joined; blank lines and headings stay apart."""
    out: list[str] = []
    for line in text.split("\n"):
        own = line.strip()
        if out and own and out[-1] and out[-1][-1] not in ends and own[0].islower():
            out[-1] += " " + own
        else:
            out.append(own)
    return "\n".join(out)


def wrap_words(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters cut between sentences, or between words where a sentence is longer."""
    out, held = [], ""
    for s in sentences(text):
        for unit in [s] if len(s) <= size else _by_words(s, size):
            if held and len(held) + 1 + len(unit) > size:
                out.append(held)
                held = ""
            held = f"{held} {unit}".strip()
    return [*out, held] if held else out


def _by_words(s: str, size: int) -> list[str]:
    out, held = [], ""
    for w in s.split():
        while len(w) > size:
            if held:
                out.append(held)
                held = ""
            out.append(w[:size])
            w = w[size:]
        if held and len(held) + 1 + len(w) > size:
            out.append(held)
            held = ""
        held = f"{held} {w}".strip()
    return [*out, held] if held else out
