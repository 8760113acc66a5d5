"""Titles, headings and terms: standard forms and replacements of the text post-processing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.rules import heading_class
from foliant.functions.text import strip

#: Number words and their digits.
NUMBER_WORDS = {
    "không": 0, "một": 1, "nhất": 1, "hai": 2, "nhị": 2, "ba": 3, "tam": 3, "bốn": 4, "tư": 4, "tứ": 4, "năm": 5, "ngũ": 5,
    "sáu": 6, "lục": 6, "bảy": 7, "thất": 7, "tám": 8, "bát": 8, "chín": 9, "cửu": 9, "mười": 10, "thập": 10,
}
KEYWORDS = "Chương|Hồi|Quyển|Tập|Phần|Q|C"
#: Pronouns, short ones before the long ones that begin with them.
PRONOUNS = (
    "anh|anh ấy|cậu|cậu ấy|ông|lão|hắn|gã|chàng|chàng ta|nàng|nàng ta|cô|cô ấy|chị|chị ấy|em|em ấy",
    "tiểu tử|nữ tử|công tử|thiếu gia|phu nhân|tiên tử|ngài|người này|gã này|tên kia",
)
NARRATIVE_PRONOUNS = ("anh", "chàng", "cô", "cậu", "cậu ấy", "hắn", "nàng", "y")
LATIN = "a-zA-ZÀ-ỹ"


def standard_title(line: Column) -> Column:
    """``chương hai: a b`` as ``Chương 2: A B``; a line that is no title stays."""
    numbers = r"\d+|" + "|".join(NUMBER_WORDS)
    pattern = rf"(?iu)^\s*(?:(?:{KEYWORDS})\s+)?({KEYWORDS})[\s:.\-]*\s*(?:thứ\s+)?({numbers})\s*[:.\-]*\s*(.*)$"
    word, number, rest = (F.regexp_extract(line, pattern, k) for k in (1, 2, 3))
    digit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), F.lower(number)), number.try_cast("int"))
    clean = F.initcap(strip(F.regexp_replace(strip(rest), r"^[:.\-\s]+", "")))
    head = F.concat(F.initcap(word), F.lit(" "), digit.cast("string"))
    return F.when((word == "") | digit.isNull(), line).when(clean == "", head).otherwise(F.concat(head, F.lit(": "), clean))


def normal_headings(text: Column) -> Column:
    """Each ``[Hn]..[/Hn]`` at the level of its class, chapters and sections in standard form; one heading a line."""

    def line(x: Column) -> Column:
        level, body = F.regexp_extract(x, r"\[(H[123])\](.*?)\[/H[123]\]", 1), strip(F.regexp_extract(x, r"\[(H[123])\](.*?)\[/H[123]\]", 2))
        kind = heading_class(body)
        target = F.when(kind == "chapter", "H1").when(kind == "section", "H2").when(kind == "subsection", "H3").otherwise(level)
        final = F.when(kind.isin("chapter", "section"), standard_title(body)).otherwise(body)
        made = F.concat(F.lit("["), target, F.lit("]"), final, F.lit("[/"), target, F.lit("]"))
        at = F.regexp_instr(x, F.lit(r"\[H[123]\].*?\[/H[123]\]"))
        old = F.regexp_extract(x, r"\[H[123]\].*?\[/H[123]\]", 0)
        return F.when(level == "", x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), made, F.substring(x, at + F.length(old), F.length(x))))

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def fix_glossary(text: Column, terms: list[tuple[str, str, str]], passes: int = 2) -> Column:
    """(source, pinyin, translation) terms replaced in the text, longest first, the pinyin in any case; a second pass meets what the first made."""
    ordered = sorted((t for t in terms if t[2]), key=lambda t: -len(t[0]) - len(t[1]))
    for _ in range(passes):
        for source, pinyin, new in ordered:
            text = F.replace(text, F.lit(source), F.lit(new)) if source else text
            text = F.regexp_replace(text, "(?iu)" + re.escape(pinyin), new.replace("\\", "\\\\").replace("$", "\\$")) if pinyin else text
    return text


def replace_spaced(text: Column, source: str, new: str) -> Column:
    """A Han term replaced with a blank on each side where a Latin letter stands."""
    own, to = re.escape(source), new.replace("\\", "\\\\").replace("$", "\\$")
    for pattern, value in ((rf"(?<=[{LATIN}]){own}(?=[{LATIN}])", f" {to} "), (rf"(?<=[{LATIN}]){own}", f" {to}"), (rf"{own}(?=[{LATIN}])", f"{to} "), (own, to)):
        text = F.regexp_replace(text, pattern, value)
    return text


def pronoun_spans(text: Column) -> Column:
    """Pronouns in order of the two lists; short forms come first in them, so they win over longer ones."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(rf"(?iU)\b({p})\b"), F.lit(1)) for p in PRONOUNS]))


def narrative_terms(text: Column, names: dict[str, str], quotes: tuple[str, ...] = ('""', "“”", "『』", "「」")) -> Column:
    """In lines that are no speech and name a character, other pronouns become the character's; names in their given order."""

    def others(pronoun: str) -> str:
        return "(?U)(?<!\\w)(?:" + "|".join(sorted((p for p in NARRATIVE_PRONOUNS if p != pronoun), key=len, reverse=True)) + ")(?!\\w)"

    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(others(p)).alias("wrong"), F.lit(p).alias("right")) for n, p in names.items()])

    def line(x: Column) -> Column:
        own = strip(x)
        speech = reduce(lambda a, b: a | b, [own.startswith(q[0]) & own.endswith(q[1]) & (F.length(own) > 1) for q in quotes])
        fixed = F.aggregate(rules, x, lambda a, r: F.when(a.contains(r["name"]), F.regexp_replace(a, r["wrong"], r["right"])).otherwise(a))
        return F.when(speech, x).otherwise(fixed)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n") if names else text


def compact_term(source: Column, pinyin: Column, new: Column, notes: Column) -> Column:
    """``source(pinyin)->new[notes]``; null without source or translation."""
    head = F.concat(source, F.when((pinyin != "") & (pinyin != source), F.concat(F.lit("("), pinyin, F.lit(")"))).otherwise(""), F.lit("->"), new)
    return F.when((source != "") & (new != ""), F.concat(head, F.when(notes != "", F.concat(F.lit("["), notes, F.lit("]"))).otherwise("")))


def split_batch(text: Column, count: Column) -> Column:
    """Paragraphs as ``count`` results: blanks for what is missing, the last one holds what is over."""
    parts = F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda x: x != "")
    n = F.size(parts)
    return (
        F.when(n <= count, F.concat(parts, F.array_repeat(F.lit(""), count - n)))
        .otherwise(F.concat(F.slice(parts, F.lit(1), count - 1), F.array(F.array_join(F.slice(parts, count, n), "\n\n"))))
    )
