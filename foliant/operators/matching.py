"""Dictionary matching: terms of a table against texts.

A term list that is proven small becomes one alternation, longest term first, so one scan of a text finds
all leftmost-longest matches. A large one is joined by equality instead: texts and terms meet on their first word (or,
for terms with Han characters, on their first character), the whole term is compared, and of the matches of a text
those that the alternation would find are kept. Both give the same terms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import HAN

#: Terms up to this many may stand in one pattern.
PATTERN_TERMS = 2000


def escape(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-#&~ ])", r"\\\1", term)


def is_han(term: str) -> bool:
    return any("一" <= c <= "鿿" for c in term)


def union_pattern(terms: list[str], whole_words: bool = True) -> str:
    """All terms, longest first, none inside a word if ``whole_words``."""
    body = "|".join(escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])" if whole_words else f"(?iu)(?:{body})"


def find_terms(text: Column, terms: list[str]) -> Column:
    """Distinct matches of the terms in a text, in lower case; Han terms also across white space."""
    plain, han = [t for t in terms if t and not is_han(t)], [t for t in terms if t and is_han(t)]
    if len(plain) + len(han) > PATTERN_TERMS:
        raise ValueError("too many terms for one pattern; use join_terms")
    out = F.array().cast("array<string>")
    if plain:
        out = F.concat(out, F.regexp_extract_all(text, F.lit(union_pattern(plain)), F.lit(0)))
    if han:
        p = F.lit(union_pattern(han, whole_words=False))
        out = F.concat(out, F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(F.regexp_replace(text, r"(?U)\s+", ""), p, F.lit(0)))
    return F.array_distinct(F.transform(out, F.lower))


#: Terms up to this many are broadcast.
BROADCAST_TERMS = 200_000
_W = r"[\p{L}\p{N}_]"


def _class(chars: list[str]) -> str:
    """A character class of the given characters."""
    return "[" + "".join(rf"\x{{{ord(c):x}}}" for c in chars) + "]" if chars else r"[^\s\S]"


def _places(docs: DataFrame, text: Column, pattern: str, most: int, first: str) -> DataFrame:
    """(_id, key columns, _at, _window, _first): the text's next ``most`` characters from each place where ``pattern`` fits."""
    windows = F.regexp_extract_all(text, F.lit(rf"(?s){pattern}(?=(.{{1,{most}}}))"), F.lit(1))
    rows = docs.select("_key", "_id", F.posexplode(windows).alias("_at", "_window"))
    return rows.withColumn("_first", F.regexp_extract("_window", first, 0))


def join_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", term: str = "term") -> DataFrame:
    """Distinct (key, term) of the leftmost-longest matches that do not overlap, for terms of any number; in lower case.

    Terms without Han characters stand between characters that are no letters, digits or underscores and are joined on
    their first word; marks before it are left out. Those with Han characters may stand anywhere, also across white space,
    and are joined on their first character. A place of a text that no term begins with leaves the task only
    if the terms are too many to be broadcast. Null and empty texts and terms match nothing.
    """
    han = F.col(term).rlike(f"[{HAN}]")
    words = terms.select(F.lower(F.col(term)).alias("_t"), han.alias("_han")).where("_t <> ''").distinct()
    words = words.withColumn("_t", F.when(F.col("_han"), F.col("_t")).otherwise(F.regexp_replace("_t", rf"^[^\p{{L}}\p{{N}}_]+", ""))).where("_t <> ''").distinct()
    sizes = words.groupBy("_han").agg(F.count("*").alias("n"), F.max(F.length("_t")).alias("most")).collect()
    base = docs.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_low")).where("_low <> ''").withColumn("_id", F.monotonically_increasing_id())
    out = None
    for r in sizes:
        own = words.where("_han" if r["_han"] else "not _han")
        if r["_han"]:
            # A term's first character is one of a few thousand at most.
            begin = _class([x[0] for x in own.select(F.left("_t", F.lit(1))).distinct().collect()])
            own = own.withColumns({"_first": F.left("_t", F.lit(1)), "_span": F.regexp_count("_t", F.lit(begin))})
            compact = F.regexp_replace("_low", r"(?U)\s+", "")
            sources = [_places(base, F.col("_low"), rf"(?={begin})", r["most"], "(?s)^."), _places(base, compact, rf"(?={begin})", r["most"], "(?s)^.")]
            fits = F.startswith(F.col("_window"), F.col("_t"))
        else:
            own = own.withColumns({"_first": F.regexp_extract("_t", f"^{_W}+", 0), "_span": F.regexp_count("_t", F.lit(rf"{_W}+"))})
            sources = [_places(base, F.col("_low"), rf"(?<!{_W})(?={_W})", r["most"] + 1, f"^{_W}+")]
            fits = F.startswith(F.col("_window"), F.col("_t")) & ~F.substr(F.col("_window"), F.length("_t") + 1, F.lit(1)).rlike(_W)
        table = F.broadcast(own) if r["n"] <= BROADCAST_TERMS else own
        for k, places in enumerate(sources):
            hits = places.join(table, "_first").where(fits).select("_key", "_id", F.lit(2 * k + r["_han"]).alias("_scan"), "_at", "_t", "_span")
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.select(F.col(key), F.lit("").alias(term)).limit(0)
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("kept"))
    take = lambda s, x: F.when(x["at"] >= s["next"], F.struct((x["at"] + x["span"]).alias("next"), F.array_union(s["kept"], F.array(x["t"])).alias("kept"))).otherwise(s)
    found = out.groupBy("_key", "_id", "_scan").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), (-F.length("_t")).alias("size"), F.col("_t").alias("t"), F.col("_span").cast("int").alias("span")))).alias("hits"))
    return found.select(F.col("_key").alias(key), F.explode(F.aggregate("hits", start, take)["kept"]).alias(term)).distinct()
