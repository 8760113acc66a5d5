"""Scores, classifiers and parsers that are rules over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import strip


def has(text: Column, *words: str) -> Column:
    """Whether the text contains any of the words as they are."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_all(text: Column, words) -> Column:
    """Occurrences of all the words, without overlap of a word with itself."""
    return reduce(lambda a, b: a + b, [((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("int") for w in words])


def complexity(text: Column, terms: Column, emotional, poetic) -> Column:
    """0 to 100: terms, emotional words, quotation marks (each counted twice, over four) and poetic words."""
    quotes = count_all(text, ['"']) * 2
    score = F.least(terms * 5, F.lit(30)) + F.least(count_all(text, emotional) * 8, F.lit(40)) + F.when(quotes > 4, 15).otherwise(0) + F.least(count_all(text, poetic) * 3, F.lit(15))
    return F.least(score, F.lit(100))


#: Seconds to wait after an error, and the factors of repeated ones.
BASE_COOLDOWN = {"rate_limit": 15, "quota_exceeded": 60, "server_error": 30, "timeout": 10, "generation_error": 30, "unknown": 60}
BACKOFF = (1, 2, 4, 8, 16)
DAY_SECONDS = 86400


def cooldown(kind: Column, retries: Column, message: Column) -> Column:
    """Seconds: the server's own delay plus one, a day for spent quotas, growing steps for server errors, else the base."""
    low = F.lower(message)
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BASE_COOLDOWN.items() for x in kv]), kind), F.lit(60))
    told = F.regexp_extract(low, r"retry\s*after[:\s]*(\d+\.?\d*)\s*s", 1)
    step = F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(retries, F.lit(len(BACKOFF) - 1)).cast("int") + 1)
    quota = (kind == "quota_exceeded") | low.contains("quota")
    return (
        F.when(((kind == "rate_limit") | message.contains("429")) & (told != "") & (told.cast("double") >= 0), F.floor(told.cast("double")).cast("int") + 1)
        .when(quota & ((retries >= 3) | low.contains("daily") | low.contains("per day")), DAY_SECONDS)
        .when(kind.isin("server_error", "timeout", "generation_error"), base * step).otherwise(base)
    )


def error_class(message: Column, kind: Column) -> Column:
    """Seven classes, the first that fits."""
    m, t = F.lower(message), F.lower(kind)
    return (
        F.when(has(m, "resource_exhausted", "quota") | t.contains("quota"), "quota_exceeded").when(has(m, "rate_limit", "too many requests"), "rate_limit")
        .when(m.contains("api key") & has(m, "not valid", "invalid") | has(m, "invalid_api_key", " 401", "401 ", " 403", "403 "), "invalid_key")
        .when(t.contains("timeout") | has(m, "timeout", "deadline"), "timeout").when(has(m, "safety", "blocked"), "generation_blocked")
        .when(message.startswith("5") | has(m, "internal", "server error"), "server_error").otherwise("unknown")
    )


#: Patterns of error types in the order in which they are tried.
ERROR_PATTERNS = {
    "invalid_key": ("invalid api key", "api key not found", "authentication failed", "unauthorized", "401"),
    "quota_exceeded": ("quota exceeded", "quota limit", "resource exhausted", "429", "rate limit exceeded"),
    "rate_limit": ("rate limit", "too many requests", "429", "throttled"),
    "network_error": ("network error", "connection error", "timeout", "connection refused", "dns"),
    "timeout": ("timeout", "timed out", "deadline exceeded"),
    "generation_error": ("generation error", "content generation failed", "model error"),
    "server_error": ("server error", "internal server error", "500", "502", "503"),
    "content_blocked": ("content blocked", "safety", "harmful content"),
    "cache_not_found": ("404", "not found", "cache", "expired"),
}


def error_pattern_class(message: Column, kind: Column) -> Column:
    """The first type with a pattern in the message, else in the name of the error's class."""
    out = None
    for text in (F.lower(message), F.lower(kind)):
        for name, words in ERROR_PATTERNS.items():
            out = F.when(has(text, *words), name) if out is None else out.when(has(text, *words), name)
    return out.otherwise("unknown")


def service_error_class(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(has(m, "429", "quota", "resourceexhausted", "resource exhausted", "rate limit"), "quota_exceeded").when(has(m, "401", "403"), "invalid_key")
        .when(has(m, "timeout", "deadline exceeded", "connection", "network", "unavailable", "503", "502", "500"), "network_error").otherwise("generation_error")
    )


def is_quota_error(message: Column) -> Column:
    m = F.lower(message)
    return message.contains("429") | has(m, "resource_exhausted", "quota", "rate limit")


def page_ranges(spec: Column) -> Column:
    """``1-3,7`` as sorted distinct numbers; parts that are no numbers or run backwards are skipped; null if none is left."""
    own = strip(spec)
    inner = F.when(own.rlike(r"^(\[.*\]|\(.*\))$"), strip(F.substring(own, F.lit(2), F.length(own) - 2))).otherwise(own)

    def part(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1).try_cast("int"), F.regexp_extract(p, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2).try_cast("int")
        one = F.regexp_extract(p, r"^\s*\+?(\d+)\s*$", 1).try_cast("int")
        none = F.array().cast("array<int>")
        return F.when(lo.isNotNull() & (lo <= hi), F.sequence(lo, F.greatest(lo, hi))).when(one > 0, F.array(one)).otherwise(none)

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(inner, ","), part))))
    return F.when(F.size(found) > 0, found)


def strip_fences(text: Column) -> Column:
    own = strip(text)
    own = F.regexp_replace(own, r"^```(json)?", "")
    return strip(F.regexp_replace(own, r"```$", ""))


def style_basics(text: Column) -> Column:
    """Pace by mean words per sentence (under 15, under 25), that mean to one place, and the number of sentences."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda x: x != "")
    words = F.aggregate(parts, F.lit(0), lambda a, x: a + F.size(F.split(x, r"(?U)\s+")))
    mean = words / F.size(parts)
    pace = F.when(mean < 15, "nhanh").when(mean < 25, "trung bình").otherwise("chậm")
    return F.when(F.size(parts) > 0, F.struct(pace.alias("pace"), F.bround(mean, 1).alias("avg_length"), F.size(parts).alias("sentence_count")))


def heading_class(text: Column) -> Column:
    """chapter, section, subsection or unknown, the first pattern that fits."""
    own = strip(text)
    chapter = r"(?iu)^(?:第?\s*\d+\s*章|第\s*\d+\s*[回卷部集]|chapter\s+\d+|part\s+\d+|part\s+[IVXLCDM]+|volume\s+\d+|book\s+\d+|episode\s+\d+|(?:Chương|Hồi|Quyển|Tập|Phần)\s+(?:thứ\s+)?(?:\d+|[A-Za-zÀ-ỹ]+))"
    section = r"(?iu)^(?:第?\s*\d+[.、]\s*\d+|section\s+\d+|mục\s+\d+|tiết\s+\d+)"
    sub = r"(?iu)^(?:subsection\s+\d+|tiểu\s+mục\s+\d+)"
    keyword = has(F.lower(own), "章", "chapter", "chương", "回")
    return F.when(own.rlike(chapter), "chapter").when(own.rlike(section), "section").when(own.rlike(sub), "subsection").when((F.length(own) <= 50) & ~own.contains(".") & keyword, "chapter").when(F.length(own) < 80, "subsection").otherwise("unknown")
