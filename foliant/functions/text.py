"""String functions of the cleaning and segmentation stages, as column expressions.

Patterns that must see letters and spaces of all scripts carry ``(?U)``. All of these stay inside
whole-stage code generation except NFC, for which the JVM side has no function.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Invisible characters that cleaning removes.
INVISIBLE = "​‌‍﻿⁠­"
#: Patterns of noise and of text structure.
URL = r"https?://[^\s]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PAGE_NUMBER = r"^\s*(?:第)?\s*\d+\s*(?:页|頁|Page|page|P\.?)?\s*$"
CJK_CLOSE = "，。！？；：、）】」』》"
CJK_OPEN = "（【「『《"
HAN = r"\x{4e00}-\x{9fff}"
CJK_WEIGHTED = r"\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}"
COMPLETE_ENDS = ".!?。！？”’」』》"
INCOMPLETE_ENDS = ",:;，：；…—-"
CONJUNCTIONS = ("và", "nhưng", "tuy", "mặc dù", "vì", "do", "nếu", "khi", "sau khi", "and", "but", "though", "although", "because", "if", "when", "after")
HEADING = r"^(?:(?:Chương|Chapter|Hồi|Quyển|Book|Vol|Volume)\s+\d+|\d+\.\s+(?:Chương|Chapter)|(?:Chương|Chapter)\s+\d+\s*:|Đệ\s+\d+\s+Chương|第\s*\d+\s*章)"


#: White space as Unicode defines it.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def _where(c: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of texts that a cheap test lets through; a text is computed once for both."""
    return F.transform(F.array(c), lambda x: F.when(test(x), change(x)).otherwise(x))[0]


def strip_bom(c: Column) -> Column:
    return F.when(c.startswith("﻿"), F.substring(c, 2, F.length(c))).otherwise(c)


def remove_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def _nfc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    return F.pandas_udf(_nfc, "string")(c)


def remove_links(c: Column) -> Column:
    c = _where(c, lambda x: x.contains("://"), lambda x: F.regexp_replace(x, URL, ""))
    return _where(c, lambda x: x.contains("@"), lambda x: F.regexp_replace(x, EMAIL, ""))


def count_links(c: Column) -> Column:
    return F.regexp_count(c, F.lit(URL)) + F.regexp_count(F.regexp_replace(c, URL, ""), F.lit(EMAIL))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def remove_page_numbers(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~strip(x).rlike("(?U)" + PAGE_NUMBER)), "\n")


def basic_whitespace(c: Column) -> Column:
    c = _single_blanks(c)
    c = F.array_join(F.transform(F.split(c, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", -1), strip), "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def advanced_whitespace(c: Column) -> Column:
    """At most one empty line, no blanks before a line end that no empty line follows, single blanks."""
    c = _where(c, lambda x: x.contains("\n\n\n"), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))
    c = _where(c, lambda x: x.contains(" \n"), lambda x: F.regexp_replace(x, r"(?<! ) +\n(?!\n)", "\n"))
    return strip(_single_blanks(c))


def _single_blanks(c: Column) -> Column:
    return _where(c, lambda x: x.contains("  ") | x.contains("\t"), lambda x: F.regexp_replace(x, r"[ \t]+", " "))


def punctuation_spacing(c: Column) -> Column:
    # All of these marks lie beyond two bytes, so a text of Latin letters alone is told by its size.
    wide = lambda x: F.octet_length(x) >= F.length(x) + 2
    c = _where(c, lambda x: wide(x) & x.rlike(f"[{CJK_CLOSE}]"), lambda x: F.regexp_replace(x, rf"(?U)(?<!\s)\s+([{CJK_CLOSE}])", "$1"))
    c = _where(c, lambda x: wide(x) & x.rlike(f"[{CJK_OPEN}]"), lambda x: F.regexp_replace(x, rf"(?U)([{CJK_OPEN}])\s+", "$1"))
    return F.regexp_replace(c, r"([.!?,;:])([A-Za-z])", "$1 $2")


def _with_before(items: Column) -> Column:
    """(x, before) structs: each item with the one before it.

    A lambda that looked into ``items`` by position would compute that array anew for every item.
    """
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))))
    return F.arrays_zip(items.alias("x"), before.alias("before"))


def drop_repeated_lines(c: Column) -> Column:
    """Without lines that repeat the line before them; blank lines end a run."""

    def kept(x: Column) -> Column:
        rows = F.filter(_with_before(lines(x)), lambda z: z["before"].isNull() | (strip(z["x"]) == "") | (strip(z["x"]) != strip(z["before"])))
        return F.array_join(F.transform(rows, lambda z: z["x"]), "\n")

    return _where(c, lambda x: x.contains("\n"), kept)


def clean(c: Column, profile: str = "safe", advanced: bool = True) -> Column:
    """What cleaning does to a text already in NFC and without invisible characters."""
    if profile != "domain_technical":
        c = remove_links(c)
    if profile == "aggressive":
        c = remove_page_numbers(c)
    c = advanced_whitespace(c) if advanced else basic_whitespace(c)
    if profile != "domain_technical":
        c = punctuation_spacing(c)
    return drop_repeated_lines(c)


def clean_documents(docs: DataFrame, profile: str = "safe", text: str = "text", advanced: bool = True) -> DataFrame:
    """The whole cleaning pipeline on a text column; profiles are safe, aggressive and domain_technical.

    NFC is a step of its own, since a Python function cannot stand inside a higher-order one; it runs only
    for texts with characters beyond Latin-1.
    """
    bare = remove_invisible(strip_bom(F.col(text)))
    docs = docs.withColumn(text, bare).withColumn(text, F.when(F.col(text).rlike(r"[^\x{00}-\x{ff}]"), nfc(F.col(text))).otherwise(F.col(text)))
    return docs.withColumn(text, clean(F.col(text), profile, advanced))


def token_weight(c: Column) -> Column:
    """Quarter tokens by character class: CJK 4, punctuation 2, white space 1, other letters and digits 1."""
    cjk = F.regexp_count(c, F.lit(f"[{CJK_WEIGHTED}]"))
    space = F.regexp_count(c, F.lit(r"(?U)\s"))
    word = F.regexp_count(c, F.lit(rf"[\p{{L}}\p{{N}}&&[^{CJK_WEIGHTED}]]"))
    return cjk * 4 + space + word + (F.length(c) - cjk - space - word) * 2


def weighted_tokens(c: Column) -> Column:
    """CJK 1, punctuation 1/2, white space 1/4, other 1/4 a character, at least 1; 0 for no text."""
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(token_weight(c) / 4))).cast("long")


def simple_tokens(c: Column, scale: float = 1.0) -> Column:
    return F.floor(F.length(c) / 4.0 * scale).cast("long")


def cjk_tokens(c: Column) -> Column:
    """1.5 a CJK character, 1/4 any other."""
    cjk = F.regexp_count(c, F.lit(f"[{CJK_WEIGHTED}]"))
    return F.floor(cjk * 1.5 + (F.length(c) - cjk) / 4.0).cast("long")


def paragraphs(c: Column) -> Column:
    """Runs of lines with content, joined; each blank line stays as an empty paragraph."""
    step = F.aggregate(
        lines(c),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")),
        lambda s, x: F.when(strip(x) != "", F.struct(s["done"].alias("done"), F.concat_ws("\n", s["open"], x).alias("open")))
        .otherwise(F.struct(F.concat(s["done"], F.array_compact(F.array(s["open"])), F.array(F.lit(""))).alias("done"), F.lit(None).cast("string").alias("open"))),
    )
    return F.concat(step["done"], F.array_compact(F.array(step["open"])))


def join_paragraphs(c: Column) -> Column:
    return F.array_join(F.transform(c, strip), "\n")


def is_incomplete(c: Column) -> Column:
    """A paragraph that seems cut: no closing mark, and a comma-like end, under 30 characters or a conjunction last."""
    own = strip(c)
    last = F.right(own, F.lit(1))
    ends = F.lower(own)
    conjunction = None
    for word in CONJUNCTIONS:
        conjunction = ends.endswith(word) if conjunction is None else conjunction | ends.endswith(word)
    cut = F.lit(INCOMPLETE_ENDS).contains(last)
    return (own != "") & ~F.lit(COMPLETE_ENDS).contains(last) & (cut | (F.length(own) < 30) | conjunction)


def sentences(c: Column) -> Column:
    """Regex sentences with their end marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?。！？]*[.!?。！？]?"), F.lit(0)), strip), lambda x: x != "")


def wrap_markers(c: Column, chunk_id: Column) -> Column:
    i = chunk_id.cast("string")
    return F.concat(F.lit("[CHUNK:"), i, F.lit(":START]\n"), c, F.lit("\n[CHUNK:"), i, F.lit(":END]"))


def strip_markers(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\[CHUNK:.*?:(START|END)\]", ""))


def collapse(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def han_runs(c: Column) -> Column:
    """Distinct runs of Han characters, longest first, then in code point order."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]+"), F.lit(0)))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("k"), x.alias("v")))), lambda s: s["v"])


def is_heading(c: Column) -> Column:
    return c.rlike("(?iu)" + HEADING)


#: Vietnamese and other Latin letters with marks and the letters they fold to.
_FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_diacritics(c: Column) -> Column:
    """Latin-1 letters without their marks."""
    return F.translate(c, _FOLD_FROM, _FOLD_TO)


def mask_key(c: Column) -> Column:
    """The last four characters behind dots; shorter keys as they are."""
    return F.when(F.length(c) >= 4, F.concat(F.lit("..."), F.right(c, F.lit(4)))).otherwise(c)


def duration(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def repair_tags(c: Column) -> Column:
    """Closing tags that fit their opening ones, tags without blanks, and a closing tag for a line that lacks it."""
    for i in (1, 2, 3):
        for j in (1, 2, 3):
            if i != j:
                c = F.regexp_replace(c, rf"(?is)\[H{i}\](.*?)\[/H{j}\]", f"[H{i}]$1[/H{i}]")
    c = F.regexp_replace(c, r"(?i)\[\s*H([1-3])\s*\]", "[H$1]")
    c = F.regexp_replace(c, r"(?i)\[\s*/\s*H([1-3])\s*\]", "[/H$1]")

    def line(x: Column) -> Column:
        own = strip(x)
        level = F.regexp_extract(own, r"(?i)^\[H([1-3])\]", 1)
        closing = F.concat(F.lit("[/H"), level, F.lit("]"))
        fixed = F.concat(strip(F.regexp_replace(own, r"(?i)\[/H[1-3]\]$", "")), F.lit(" "), closing)
        return F.when((level != "") & ~F.upper(own).contains(F.upper(closing)), fixed).otherwise(x)

    return F.array_join(F.transform(lines(c), line), "\n")


def tags_to_markdown(c: Column) -> Column:
    c = repair_tags(c)
    for i in (1, 2, 3):
        c = F.regexp_replace(c, rf"(?i)\[H{i}\](.*?)\[/H{i}\]", "#" * i + " $1")
    return c


def minify(c: Column) -> Column:
    """Single blanks, trimmed lines, at most one empty line in a row."""
    own = F.transform(lines(strip(c)), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    kept = F.filter(_with_before(own), lambda z: (z["x"] != "") | z["before"].isNull() | (z["before"] != ""))
    return F.array_join(F.transform(kept, lambda z: z["x"]), "\n")


def minify_context(c: Column) -> Column:
    c = F.regexp_replace(strip(c), r"\*\*([^*]+)\*\*", "$1")
    c = F.regexp_replace(c, r"__([^_]+)__", "$1")
    return F.array_join(F.filter(F.transform(lines(c), strip), lambda x: x != ""), "\n")


def tidy_spacing(c: Column) -> Column:
    for pattern, to in ((r"  +", " "), (r" +([,\.。!?;:！？，])", "$1"), (r"\(\s+", "("), (r"\s+\)", ")"), (r'"\s+', '"'), (r'\s+"', '"')):
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_text_ids(c: Column) -> Column:
    return F.regexp_replace(c, r"\[TX:[^\]]+\]", "")


def bisect(c: Column, reach: int = 2000) -> Column:
    """Two halves cut at the last line end within ``reach`` of the middle, else in the middle."""
    mid = F.floor(F.length(c) / 2).cast("int")
    low = F.greatest(F.lit(0), mid - reach)
    window = F.substring(c, low + 1, F.least(F.length(c), mid + reach) - low)
    back = F.locate("\n", F.reverse(window))
    cut = F.when(back > 0, low + F.length(window) - back).otherwise(mid)
    return F.struct(strip(F.substring(c, F.lit(1), cut)).alias("first"), strip(F.substring(c, cut + 1, F.length(c))).alias("second"))


def scan_metrics(c: Column) -> Column:
    """Line count, mean length, and shares of short (under 8) and noisy (over 45 % marks) lines of a scanned text."""
    own = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    n = F.size(own).cast("double")
    noisy = F.filter(own, lambda x: F.regexp_count(x, F.lit(r"(?U)[^\p{L}\p{N}\s]")) / F.length(x) > 0.45)
    total = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    some = n > 0
    return F.struct(
        n.alias("line_count"),
        F.when(some, total / n).otherwise(0.0).alias("avg_line_length"),
        F.when(some, F.size(F.filter(own, lambda x: F.length(x) < 8)) / n).otherwise(1.0).alias("short_line_ratio"),
        F.when(some, F.size(noisy) / n).otherwise(1.0).alias("noisy_line_ratio"),
    )


def scan_gate(c: Column, enabled: bool = True, min_chars: int = 800, min_avg: float = 24.0, max_short: float = 0.55, max_noisy: float = 0.25) -> Column:
    m = scan_metrics(c)
    return (
        F.when(F.lit(not enabled), "disabled").when(F.length(strip(c)) < min_chars, "below_min_chars").when(m["avg_line_length"] < min_avg, "avg_line_too_short")
        .when(m["short_line_ratio"] > max_short, "too_many_short_lines").when(m["noisy_line_ratio"] > max_noisy, "too_noisy").otherwise("passed")
    )
