"""Queries of chunking, merging and the validation gates; the flagship query is the first."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.rules import count_all, has
from foliant.operators import merging as M
from foliant.operators.chunking import Chunker, chunk_documents, fold_documents, pack_entries, weighted_tokens
from foliant.plans.inject import INJ, injected
from foliant.plans.q_text import NL, SPLIT, WEIGHTED, advanced, no_repeats, punctuation, strip
from foliant.operators.windows import running_past
from foliant.registry import query, table

LIMIT = 200


def _lines(text: str) -> list[tuple]:
    own = text.split("\n")
    sizes = [weighted_tokens(x) for x in own]
    groups: dict[int, list[int]] = {}
    for g, n in zip(pack_entries(sizes, LIMIT), sizes, strict=True):
        groups.setdefault(g, []).append(n)
    return [(g, sum(n), len(n)) for g, n in groups.items()]


@query("chunk_cleaned_documents", f"""WITH RECURSIVE {INJ}, c AS (SELECT doc_id, {punctuation(advanced("regexp_replace(text, '[\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x{2060}\\x{ad}]', '', 'g')"))} AS text FROM inj), r AS (SELECT doc_id, {no_repeats('text')} AS text FROM c),
    l AS (SELECT doc_id, text, no, {WEIGHTED} AS tokens FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS text, generate_subscripts(string_split(text, {NL}), 1) AS no FROM r)),
    f(doc_id, no, chunk_id, total, tokens) AS (SELECT doc_id, no, 1::BIGINT, tokens, tokens FROM l WHERE no = 1 UNION ALL
      SELECT l.doc_id, l.no, CASE WHEN f.total + l.tokens > {LIMIT} THEN f.chunk_id + 1 ELSE f.chunk_id END, CASE WHEN f.total + l.tokens > {LIMIT} THEN l.tokens ELSE f.total + l.tokens END, l.tokens FROM f JOIN l ON l.doc_id = f.doc_id AND l.no = f.no + 1)
    SELECT doc_id, chunk_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_lines FROM f GROUP BY 1, 2""")
def chunk_cleaned_documents(s, d):
    """Cleaned documents, their lines packed into chunks of at most LIMIT tokens."""
    docs = injected(s, d).withColumn("text", X.drop_repeated_lines(X.punctuation_spacing(X.advanced_whitespace(X.remove_invisible(F.col("text"))))))
    return fold_documents(docs, _lines, "chunk_id bigint, tokens bigint, n_lines bigint")


def _sizes(pieces):
    return [(k, p.tokens) for k, p in enumerate(pieces)]


query("ch01_hybrid_chunks")(lambda s, d: chunk_documents(injected(s, d), Chunker(LIMIT)).drop("text"))
query("ch02_paragraph_packing")(lambda s, d: chunk_documents(injected(s, d), Chunker(LIMIT), "pack").drop("text"))
query("ch04_balanced_chunks")(lambda s, d: fold_documents(injected(s, d), lambda t: _sizes(Chunker(LIMIT).cap(Chunker(LIMIT).balanced(Chunker(LIMIT).pack(t)))), "chunk_id bigint, tokens bigint"))


def _blocks(t):
    from foliant.operators.chunking import _HEADING

    return [("heading" if _HEADING.match(x.strip()) else "paragraph", x) for x in t.split("\n")]


query("ch03_block_chunks")(lambda s, d: fold_documents(injected(s, d), lambda t: _sizes(Chunker(LIMIT).by_blocks(_blocks(t))), "chunk_id bigint, tokens bigint"))
query("ch05_capped_chunks")(lambda s, d: fold_documents(injected(s, d), lambda t: _sizes(Chunker(LIMIT).cap(Chunker(4 * LIMIT).pack(t))), "chunk_id bigint, tokens bigint"))
query("ch06_size_validation", f"SELECT doc_id, tokens < 100 AND NOT is_last AS is_small FROM (SELECT doc_id, {WEIGHTED} AS tokens, doc_id = max(doc_id) OVER (PARTITION BY source) AS is_last FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", "source", X.weighted_tokens(F.col("text")).alias("tokens")).join(table(s, d, "documents").groupBy("source").agg(F.max("doc_id").alias("last")), "source").select("doc_id", ((F.col("tokens") < 100) & (F.col("doc_id") != F.col("last"))).alias("is_small"))
)


@query("ch07_text_map_packing", """WITH RECURSIVE e AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations),
    f(conv_id, turn, no, chunk_id, total) AS (SELECT conv_id, turn, no, 1::BIGINT, greatest(1, size) FROM e WHERE no = 1 UNION ALL SELECT e.conv_id, e.turn, e.no, CASE WHEN f.total + greatest(1, e.size) > 300 THEN f.chunk_id + 1 ELSE f.chunk_id END, CASE WHEN f.total + greatest(1, e.size) > 300 THEN greatest(1, e.size) ELSE f.total + greatest(1, e.size) END FROM f JOIN e ON e.conv_id = f.conv_id AND e.no = f.no + 1)
    SELECT conv_id, chunk_id, count(*) AS n, string_agg('t' || turn, ',' ORDER BY turn) AS text_ids FROM f GROUP BY 1, 2""")
def text_map_packing(s, d):
    """Entries in order into chunks of at most 300 characters, with their ids."""
    entries = F.array_sort(F.collect_list(F.struct("turn", F.greatest(F.lit(1), F.length("text")).alias("size"))))
    grouped = table(s, d, "conversations").groupBy("conv_id").agg(entries.alias("z"))
    state = F.struct(F.lit(1).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("out"))

    def step(a, x):
        over = (a["total"] > 0) & (a["total"] + x["size"] > 300)
        chunk = F.when(over, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(over, x["size"].cast("bigint")).otherwise(a["total"] + x["size"]).alias("total"), F.array_append(a["out"], chunk).alias("out"))

    rows = grouped.select("conv_id", F.explode(F.arrays_zip(F.col("z").alias("e"), F.aggregate("z", state, step)["out"].alias("c"))).alias("x"))
    packed = rows.groupBy("conv_id", F.col("x.c").alias("chunk_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("x.e.turn")).alias("t"))
    return packed.select("conv_id", "chunk_id", "n", F.array_join(F.transform("t", lambda t: F.concat(F.lit("t"), t.cast("string"))), ",").alias("text_ids"))


query("ch08_fixed_slices", "SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 1000) AS BIGINT))) AS no, substr(text, CAST(unnest(range(0, CAST(ceil(length(text) / 1000) AS BIGINT))) * 1000 + 1 AS BIGINT), 1000) AS piece FROM documents")(
    lambda s, d: table(s, d, "documents").where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.length("text") / 1000) - 1)).alias("no")).select("doc_id", "no", F.substring(F.col("text"), (F.col("no") * 1000 + 1).cast("int"), F.lit(1000)).alias("piece"))
)
query("txt14_quoted_sentences")(lambda s, d: fold_documents(injected(s, d), lambda t: [(k, x) for k, x in enumerate(Chunker.sentences(t))], "no bigint, sentence string"))
query("txt16_hard_split")(lambda s, d: fold_documents(injected(s, d), lambda t: [(k, weighted_tokens(x)) for k, x in enumerate(Chunker(50).hard_split(t))], "no bigint, tokens bigint"))
query("txt17_word_wrap")(lambda s, d: fold_documents(injected(s, d), lambda t: [(k, len(x)) for k, x in enumerate(M.wrap_words(t, 500))], "no bigint, size bigint"))
query("txt18_rejoin_lines")(lambda s, d: fold_documents(injected(s, d), lambda t: [(M.rejoin_lines(t),)], "out string"))


def merged(s, d, fold):
    """A fold over the ordered texts of each conversation; a conversation is a bounded group of turns."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\x1e").alias("text"))
    return fold_documents(c, lambda t: [(fold(t.split("\x1e")),)], "out string", "conv_id")


query("txt28_merge_without_overlap")(lambda s, d: merged(s, d, M.merge_without_overlap))
query("txt31_merge_paragraphs")(lambda s, d: merged(s, d, M.merge_paragraphs))
MARKED = "CASE doc_id % 4 WHEN 0 THEN '[CHUNK:1:START]' || text || '[CHUNK:1:END]' WHEN 1 THEN text WHEN 2 THEN '[CHUNK:1:START]' || text ELSE '[CHUNK:1:START][CHUNK:1:START]' || text || '[CHUNK:1:END]' END"


def with_markers(s, d):
    k, t = F.col("doc_id") % 4, F.col("text")
    a, b = F.lit("[CHUNK:1:START]"), F.lit("[CHUNK:1:END]")
    return table(s, d, "documents").select("doc_id", F.when(k == 0, F.concat(a, t, b)).when(k == 1, t).when(k == 2, F.concat(a, t)).otherwise(F.concat(a, a, t, b)).alias("text"))


query("txt29_marker_counts", f"SELECT doc_id, a AS starts, b AS ends, (a = 1 AND b = 1) OR (a = 0 AND b = 0) AS valid FROM (SELECT doc_id, CAST(len(regexp_extract_all(t, '\\[CHUNK:1:START\\]')) AS BIGINT) AS a, CAST(len(regexp_extract_all(t, '\\[CHUNK:1:END\\]')) AS BIGINT) AS b FROM (SELECT doc_id, {MARKED} AS t FROM documents))")(
    lambda s, d: with_markers(s, d).select("doc_id", F.regexp_count("text", F.lit(r"\[CHUNK:1:START\]")).cast("long").alias("starts"), F.regexp_count("text", F.lit(r"\[CHUNK:1:END\]")).cast("long").alias("ends")).withColumn("valid", ((F.col("starts") == 1) & (F.col("ends") == 1)) | ((F.col("starts") == 0) & (F.col("ends") == 0)))
)
query("txt30_marker_repair", f"SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '[CHUNK:1:START]' || text || '[CHUNK:1:END]' ELSE {MARKED} END AS out FROM documents")(lambda s, d: fold_documents(with_markers(s, d), lambda t: [(M.repair_markers(t, 1),)], "out string"))
# Validation gates: each turn against the one before it
PAIR = "p AS (SELECT conv_id, turn, text AS t, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations)"


def pairs(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"), F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("o")).where("o is not null")


def full_lines(c):
    return F.size(F.filter(X.lines(c), lambda x: X.strip(x) != ""))


def full(x):
    return f"len(list_filter(string_split({x}, {NL}), lambda x: {strip('x')} <> ''))"


query("vg01_content_coverage", f"WITH {PAIR} SELECT conv_id, turn, length({strip('t')}) / greatest(1, length({strip('o')})) >= 0.25 AND {full('t')} / {full('o')} >= 0.25 AS covered FROM p WHERE o IS NOT NULL AND {full('o')} > 0")(
    lambda s, d: pairs(s, d).where(full_lines(F.col("o")) > 0).select("conv_id", "turn", ((F.length(X.strip(F.col("t"))) / F.greatest(F.lit(1), F.length(X.strip(F.col("o")))) >= 0.25) & (full_lines(F.col("t")) / full_lines(F.col("o")) >= 0.25)).alias("covered"))
)
query("vg02_minimal_validity", f"WITH {PAIR} SELECT conv_id, turn, length({strip('t')}) >= 10 AND length(t) >= length(o) * 0.2 AS valid FROM p WHERE o IS NOT NULL")(lambda s, d: pairs(s, d).select("conv_id", "turn", ((F.length(X.strip(F.col("t"))) >= 10) & (F.length("t") >= F.length("o") * 0.2)).alias("valid")))
ENDINGS = (".", "!", "?", '"', "”", "’", "…", ">", ")", "]", "}", "—", "-")
VERBS = ("said:", "asked:", "the ", "of ")
QUOTED = "len(regexp_extract_all({0}, '[\"“”「」『』]'))"


@query("vg03_translation_issues", f"""WITH {PAIR}, q AS (SELECT *, {QUOTED.format('o')} AS qo, len(regexp_extract_all(t, '["“”]')) AS qt, {' + '.join(f"(length(lower(t)) - length(replace(lower(t), '{v}', ''))) / {len(v)}" for v in VERBS)} AS verbs FROM p WHERE o IS NOT NULL)
    SELECT conv_id, turn, {strip('t')} = '' OR contains('{''.join(e for e in ENDINGS)}', right({strip('t')}, 1)) AS whole, qo > 0 AND qt < qo AND (qo - qt) / qo > 0.2 AS quotes_missing, length(t) > 1200 AND NOT contains(t, chr(10) || chr(10)) AS unspaced, verbs > 3 AND qt / 2 < verbs * 0.1 AS unquoted FROM q""")
def translation_issues(s, d):
    """Four checks of a translation: its last mark, missing quotation marks, paragraph spacing, speech without marks."""
    own = X.strip(F.col("t"))
    rows = pairs(s, d).withColumns({"qo": F.regexp_count("o", F.lit('["“”「」『』]')), "qt": F.regexp_count("t", F.lit('["“”]')), "verbs": count_all(F.lower("t"), VERBS)})
    return rows.select(
        "conv_id", "turn", ((own == "") | F.lit("".join(ENDINGS)).contains(F.right(own, F.lit(1)))).alias("whole"), ((F.col("qo") > 0) & (F.col("qt") < F.col("qo")) & ((F.col("qo") - F.col("qt")) / F.col("qo") > 0.2)).alias("quotes_missing"),
        ((F.length("t") > 1200) & ~F.col("t").contains("\n\n")).alias("unspaced"), ((F.col("verbs") > 3) & (F.col("qt") / 2 < F.col("verbs") * 0.1)).alias("unquoted"),
    )


GLOSSARY = (("剑法", "sword art"), ("世界", "world"), ("你好", "hello"))
GLOSSARY_SQL = ", ".join(f"('{a}', '{b}')" for a, b in GLOSSARY)
query("vg04_glossary_violations", f"WITH {INJ}, h AS (SELECT doc_id, g.a, g.b, contains(text, g.a) AS wrong, NOT contains(text, g.b) AND contains(text, g.a) AS missed FROM inj, (VALUES {GLOSSARY_SQL}) g(a, b)) SELECT doc_id, 'glossary_violation' AS type, a AS original FROM h WHERE wrong UNION ALL SELECT doc_id, 'glossary_missing', a FROM h WHERE missed UNION ALL SELECT doc_id, 'glossary_summary', CAST(count(*) FILTER (wrong) AS VARCHAR) FROM h GROUP BY doc_id HAVING bool_or(wrong)")(
    lambda s, d: glossary_violations(s, d)
)


def glossary_violations(s, d):
    """Source terms left in a text, terms whose translation is missing, and a summary row; one scan of each text."""
    t = F.col("text")
    found = F.array_compact(F.array(*[F.when(t.contains(a), F.struct(F.lit(a).alias("a"), (~t.contains(b)).alias("missed"))) for a, b in GLOSSARY]))
    rows = injected(s, d).withColumn("f", found).where("size(f) > 0")
    kinds = F.concat(
        F.transform("f", lambda x: F.struct(F.lit("glossary_violation").alias("type"), x["a"].alias("original"))),
        F.transform(F.filter("f", lambda x: x["missed"]), lambda x: F.struct(F.lit("glossary_missing").alias("type"), x["a"].alias("original"))),
        F.array(F.struct(F.lit("glossary_summary").alias("type"), F.size("f").cast("string").alias("original"))),
    )
    return rows.select("doc_id", F.explode(kinds).alias("x")).select("doc_id", "x.*")


query("vg05_compliance_score", f"WITH {INJ}, h AS (SELECT doc_id, {' + '.join(f'CASE WHEN contains(text, {chr(39)}{a}{chr(39)}) THEN 1 ELSE 0 END' for a, _ in GLOSSARY)} AS high, CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 1 ELSE 0 END AS critical FROM inj) SELECT doc_id, greatest(0, 100 - 50 * critical - 20 * high) AS score, greatest(0, 100 - 50 * critical - 20 * high) < 60 AND high + critical > 0 AS needs_retry FROM h")(
    lambda s, d: injected(s, d).withColumns({"high": sum((F.col("text").contains(a).cast("int") for a, _ in GLOSSARY), F.lit(0)), "critical": F.col("text").rlike(r"[\x{4e00}-\x{9fff}]").cast("int")}).withColumn("score", F.greatest(F.lit(0), 100 - 50 * F.col("critical") - 20 * F.col("high"))).select("doc_id", "score", ((F.col("score") < 60) & (F.col("high") + F.col("critical") > 0)).alias("needs_retry"))
)
query("vg06_metadata_leftovers", f"WITH {INJ} SELECT doc_id, {' OR '.join(f'contains(text, {chr(39)}{a}{chr(39)})' for a, _ in GLOSSARY)} OR contains(lower(text), 'apache') AS leftover FROM inj")(lambda s, d: injected(s, d).select("doc_id", (has(F.col("text"), *[a for a, _ in GLOSSARY]) | F.lower("text").contains("apache")).alias("leftover")))


@query("vg07_size_ladder", """WITH r AS (SELECT event_id, user_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS is_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, CASE WHEN value < 5 AND NOT is_last THEN 'below_minimum_size' WHEN is_last AND value < 2.5 THEN 'last_chunk_too_small' WHEN NOT is_last AND n >= 3 AND value < m * 0.15 THEN 'extremely_small_chunk' WHEN n < 3 THEN 'insufficient_data' WHEN value < m * 0.8 AND (NOT is_last OR abs(m - value) / m > 0.3) THEN 'size_deviation' ELSE 'normal_size' END AS reason FROM r""")
def size_ladder(s, d):
    """The reason a size is odd, judged by the sizes before it of the same key."""
    rows = running_past(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value")
    rows = rows.withColumns({"n": F.col("past_n"), "m": F.col("past_mean")})
    v, m, last = F.col("value"), F.col("m"), F.col("is_last")
    return rows.select(
        "event_id",
        F.when((v < 5) & ~last, "below_minimum_size").when(last & (v < 2.5), "last_chunk_too_small").when(~last & (F.col("n") >= 3) & (v < m * 0.15), "extremely_small_chunk").when(F.col("n") < 3, "insufficient_data")
        .when((v < m * 0.8) & (~last | (F.abs(m - v) / m > 0.3)), "size_deviation").otherwise("normal_size").alias("reason"),
    )


query("vg08_style_rule", "SELECT doc_id, contains(lower(text), 'license') AS violation FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.lower("text").contains("license").alias("violation")))
query("vg09_merge_gate", f"SELECT source, count(*) = max(doc_id // 1000) + count(*) AS complete, count(*) FILTER ({strip('text')} = '') = 0 AS no_blank FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").groupBy("source").agg((F.count("*") == F.max(F.floor(F.col("doc_id") / 1000)) + F.count("*")).alias("complete"), (F.count_if(X.strip(F.col("text")) == "") == 0).alias("no_blank"))
)
