"""Queries of row filters, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators.lines import explode_lines
from foliant.operators.windows import around, global_row_number, group_row_number, islands, repeated, top_per_key, trailing_count
from foliant.plans.inject import INJ, injected
from foliant.plans.q_text import NL, SPLIT, strip
from foliant.registry import query, table

LINES = f"{INJ}, l AS (SELECT doc_id, source, unnest({SPLIT}) AS line, generate_subscripts({SPLIT}, 1) - 1 AS no FROM inj)"


def lines_of(s, d):
    return explode_lines(injected(s, d)).withColumn("no", F.col("no").cast("long"))


PAGE = "^\\s*(?:第)?\\s*\\d+\\s*(?:页|頁|Page|page|P\\.?)?\\s*$"
query("flt05_page_number_lines", f"WITH {LINES} SELECT doc_id, no FROM l WHERE regexp_matches({strip('line')}, '{PAGE}')")(lambda s, d: lines_of(s, d).where(X.strip(F.col("line")).rlike("(?U)" + X.PAGE_NUMBER)).select("doc_id", "no"))
query("flt06_without_repeated_lines", f"WITH {LINES} SELECT doc_id, no, line FROM (SELECT *, {strip('line')} AS s, lag({strip('line')}) OVER (PARTITION BY doc_id ORDER BY no) AS p FROM l) WHERE NOT (s <> '' AND s IS NOT DISTINCT FROM p)")(
    lambda s, d: lines_of(s, d).withColumn("t", X.strip(F.col("line"))).withColumn("r", repeated(None, "doc_id", "no", F.col("t"))).where("t = '' or not r").select("doc_id", "no", "line")
)
MARK = r"(?i)^(?:第\s*[零一二三四五六七八九十百千0-9]+\s*[章回节卷篇部]|Chapter\s+\d+|Chương\s+\d+)"


@query("flt07_chapter_markers", f"""WITH {LINES}, p AS (SELECT doc_id, no, {strip('line')} AS title, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) - 1 AS BIGINT) AS position FROM l),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k FROM p WHERE title <> '' AND length(title) <= 120 AND len(regexp_extract_all(title, '[.!?,:;。，！？”“"\\-]')) <= 2 AND regexp_matches(title, '{MARK}') AND (regexp_matches(title, '\\d') OR starts_with(title, '第')))
    SELECT doc_id, no AS line_number, title, position FROM q WHERE k <= 2000""")
def chapter_markers(s, d):
    w = W.partitionBy("doc_id").orderBy("no")
    before = F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = lines_of(s, d).withColumn("position", (F.coalesce(before, F.lit(1)) - 1).cast("long")).withColumn("title", X.strip(F.col("line")))
    rows = rows.where((F.col("title") != "") & (F.length("title") <= 120) & (F.regexp_count("title", F.lit(r'[.!?,:;。，！？”“"\-]')) <= 2))
    rows = rows.where(F.col("title").rlike("(?iu)" + MARK[4:]) & (F.col("title").rlike(r"\d") | F.col("title").startswith("第")))
    return top_per_key(rows, ["doc_id"], [F.col("no")], 2000).select("doc_id", F.col("no").alias("line_number"), "title", "position")


def block_type(line):
    own = X.strip(line)
    return (
        F.when(own == "", "divider").when(own.rlike(r"(?iu)^(?:#{1,6}\s+.+|(?:Chapter|Chương|第.+章).*)$"), "heading").when(own.rlike(r"^(?:[-*+]\s+.+|\d+\.\s+.+)$"), "list_item")
        .when(F.regexp_count(own, F.lit(r"\|")) >= 2, "table_text").when(own.rlike(r"!\[[^\]]*\]\(([^)]+)\)"), "image_ref").otherwise("paragraph")
    )


TYPE = f"CASE WHEN {strip('line')} = '' THEN 'divider' WHEN regexp_matches({strip('line')}, '(?i)^(?:#{{1,6}}\\s+.+|(?:Chapter|Chương|第.+章).*)$') THEN 'heading' WHEN regexp_matches({strip('line')}, '^(?:[-*+]\\s+.+|\\d+\\.\\s+.+)$') THEN 'list_item' WHEN len(regexp_extract_all(line, '\\|')) >= 2 THEN 'table_text' WHEN regexp_matches(line, '!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'image_ref' ELSE 'paragraph' END"


def structured(s, d):
    """Blocks by line; a divider goes if it is first or follows one."""
    rows = lines_of(s, d).withColumn("type", block_type(F.col("line")))
    before = F.lag("type").over(W.partitionBy("doc_id").orderBy("no"))
    return rows.withColumn("before", before).where("type <> 'divider' or (before is not null and before <> 'divider')").select("doc_id", F.concat(F.lit("b"), F.col("no").cast("string")).alias("id"), "no", "type", F.regexp_replace("line", r"(?U)\s+$", "").alias("text"))


IR = f"ir AS (SELECT doc_id, 'b' || no AS id, no, type, regexp_replace(line, '\\s+$', '') AS text FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM (SELECT doc_id, no, line, {TYPE} AS type FROM l)) WHERE type <> 'divider' OR (before IS NOT NULL AND before <> 'divider'))"
query("flt08_structured_blocks", f"WITH {LINES}, {IR} SELECT doc_id, id, type, text FROM ir")(lambda s, d: structured(s, d).select("doc_id", "id", "type", "text"))
query("ht04_blocks_to_text", f"WITH {LINES}, {IR} SELECT doc_id, {strip(f'string_agg(text, {NL} ORDER BY no)')} AS out FROM ir GROUP BY doc_id")(
    lambda s, d: structured(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("z")).select("doc_id", X.strip(F.array_join(F.transform("z", lambda x: x["text"]), "\n")).alias("out"))
)


def frequent_lines(s, d, share: float):
    """Lines that stand in at least a share of the texts of a source, each text counted once."""
    rows = lines_of(s, d).join(table(s, d, "documents").select("doc_id", "source"), "doc_id").withColumn("t", X.strip(F.col("line"))).where("t <> ''")
    pages = table(s, d, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("pages"))
    counts = rows.select("source", "doc_id", "t").distinct().groupBy("source", "t").agg(F.count("*").alias("n"))
    return counts.join(pages, "source").where(F.col("n") / F.col("pages") >= share).select("source", F.col("t").alias("line"), "n")


query("flt09_repeated_headers", f"WITH {LINES}, p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source) SELECT source, line, n FROM (SELECT source, {strip('line')} AS line, count(DISTINCT doc_id) AS n FROM l WHERE {strip('line')} <> '' GROUP BY 1, 2) JOIN p USING (source) WHERE n / pages >= 0.04")(lambda s, d: frequent_lines(s, d, 0.04))
query("flt10_repeated_short_paragraphs", f"WITH {LINES}, c AS (SELECT source, {strip('line')} AS line FROM l), t AS (SELECT source, count(*) AS n_all FROM c GROUP BY source) SELECT source, line, n FROM (SELECT source, line, count(*) AS n FROM c WHERE line <> '' AND length(line) <= 120 GROUP BY 1, 2) JOIN t USING (source) WHERE n / n_all >= 0.02")(
    lambda s, d: short_repeats(s, d)
)


def short_repeats(s, d):
    rows = explode_lines(injected(s, d).withColumn("source", F.col("source")), "doc_id").join(table(s, d, "documents").select("doc_id", "source"), "doc_id").select("source", X.strip(F.col("line")).alias("line"))
    total = rows.groupBy("source").agg(F.count("*").alias("n_all"))
    counts = rows.where((F.col("line") != "") & (F.length("line") <= 120)).groupBy("source", "line").agg(F.count("*").alias("n"))
    return counts.join(total, "source").where(F.col("n") / F.col("n_all") >= 0.02).select("source", "line", "n")


BANNED = ("license", "example.org", "世界")
query("flt11_without_patterns", f"WITH {LINES} SELECT doc_id, no FROM l WHERE NOT (" + " OR ".join(f"contains(lower(line), '{b}')" for b in BANNED) + ")")(
    lambda s, d: lines_of(s, d).where(~F.exists(F.array(*map(F.lit, BANNED)), lambda b: F.lower("line").contains(b))).select("doc_id", "no")
)
query("flt12_watermark_lines", f"WITH {LINES} SELECT doc_id, no FROM l WHERE contains(lower(strip_accents(regexp_replace(line, '[^\\x{{00}}-\\x{{ff}}]', '', 'g'))), 'licensed under')")(
    lambda s, d: lines_of(s, d).where(F.lower(X.strip_diacritics(F.regexp_replace("line", r"[^\x{00}-\x{ff}]", ""))).contains("licensed under")).select("doc_id", "no")
)
query("flt13_diagonal_text", "SELECT event_id, degrees(atan2(value, 100.0)) AS angle FROM events WHERE abs(degrees(atan2(value, 100.0))) BETWEEN 20 AND 70 AND length(props) >= 8 AND contains(lower(props), 'a')")(
    lambda s, d: table(s, d, "events").withColumn("angle", F.degrees(F.atan2("value", F.lit(100.0)))).where((F.abs("angle").between(20, 70)) & (F.length("props") >= 8) & F.lower("props").contains("a")).select("event_id", "angle")
)
query("flt14_band_words", "SELECT event_id, value AS y FROM events WHERE (value <= 0.08 * 1000 OR value >= 0.92 * 1000) AND event_type <> ''")(
    lambda s, d: table(s, d, "events").where("(value <= 0.08 * 1000 or value >= 0.92 * 1000) and event_type <> ''").select("event_id", F.col("value").alias("y"))
)
SKIP = ("wait,", "thinking,", "correction:", "actually,")
REASONING = ("Wait,", "Okay,", "Here is", "I will", "Actually,")
RESPONSE = "'```' || chr(10) || 'Okay, here is it' || chr(10) || '* Wait, short' || chr(10) || 'Wait, no' || chr(10) || text || chr(10) || '[CHUNK:1:END]' || chr(10) || '```'"


@query("flt16_strip_reasoning", f"WITH r AS (SELECT doc_id, unnest(string_split({RESPONSE}, {NL})) AS line, generate_subscripts(string_split({RESPONSE}, {NL}), 1) AS no FROM documents), k AS (SELECT *, {strip('line')} AS s FROM r WHERE {strip('line')} NOT IN ('```', '```json', '```msg') AND NOT (" + " OR ".join(f"starts_with(lower({strip('line')}), '{w}')" for w in SKIP) + f") AND NOT (starts_with({strip('line')}, '*') AND length({strip('line')}) < 150 AND (" + " OR ".join(f"contains(lower(line), '{w.lower()}')" for w in REASONING) + f"))) SELECT doc_id, {strip('regexp_replace(' + strip(f'string_agg(line, {NL} ORDER BY no)') + ', ' + chr(39) + chr(92) + '[CHUNK:.*?:(START|END)' + chr(92) + ']' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS out FROM k GROUP BY doc_id")
def strip_reasoning(s, d):
    response = F.concat(F.lit("```\nOkay, here is it\n* Wait, short\nWait, no\n"), F.col("text"), F.lit("\n[CHUNK:1:END]\n```"))

    def keep(x):
        own, low = X.strip(x), F.lower(x)
        starts = None
        for w in SKIP:
            hit = F.lower(own).startswith(w)
            starts = hit if starts is None else starts | hit
        reason = F.exists(F.array(*[F.lit(w.lower()) for w in REASONING]), lambda w: low.contains(w))
        return ~own.isin("```", "```json", "```msg") & ~starts & ~(own.startswith("*") & (F.length(own) < 150) & reason)

    kept = F.array_join(F.filter(X.lines(response), keep), "\n")
    return table(s, d, "documents").select("doc_id", X.strip_markers(X.strip(kept)).alias("out"))


query("flt17_log_noise", "SELECT event_id FROM events WHERE NOT regexp_matches(event_type || ' ' || props, '(?i)(view|\"k\": ?[0-3])')")(lambda s, d: table(s, d, "events").where(~F.concat_ws(" ", "event_type", "props").rlike('(?i)(view|"k": ?[0-3])')).select("event_id"))
query("flt18_valid_chunks", f"SELECT source, count(*) FILTER (length({strip('text')}) >= 200) AS valid_count, count(*) FILTER (length({strip('text')}) < 200) AS invalid_count, count(*) FILTER (length({strip('text')}) < 200) = 0 AS valid, count(*) AS total FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").withColumn("ok", F.length(X.strip(F.col("text"))) >= 200).groupBy("source").agg(F.count_if("ok").alias("valid_count"), F.count_if(~F.col("ok")).alias("invalid_count"), (F.count_if(~F.col("ok")) == 0).alias("valid"), F.count("*").alias("total"))
)
query("flt19_result_validity", "SELECT event_id, CASE WHEN props IS NULL THEN 'missing' WHEN props = '' THEN 'empty' WHEN trim(props) = '' THEN 'blank' WHEN NOT contains(props, '{') THEN 'not_an_object' ELSE 'valid' END AS status FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("props").isNull(), "missing").when(F.col("props") == "", "empty").when(X.strip(F.col("props")) == "", "blank").when(~F.col("props").contains("{"), "not_an_object").otherwise("valid").alias("status"))
)
# Windows
query("wn02_context_candidates", "SELECT a.conv_id, a.turn, b.turn AS candidate, a.turn - b.turn AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1")(
    lambda s, d: (lambda c: c.withColumn("candidate", F.explode(F.sequence(F.col("turn") - 3, F.col("turn") - 1))).join(c.select("conv_id", F.col("turn").alias("candidate")), ["conv_id", "candidate"]).select("conv_id", "turn", "candidate", (F.col("turn") - F.col("candidate")).alias("distance")))(table(s, d, "conversations").select("conv_id", "turn"))
)
WINDOW_SIZE = "(CASE WHEN length(text) > 5000 THEN 2 WHEN length(text) > 3000 THEN 1 ELSE 0 END + CASE WHEN {q} THEN 1 ELSE 0 END + CASE WHEN {b} THEN 1 ELSE 0 END)"
SIZE_SQL = WINDOW_SIZE.format(q="contains(text, chr(34))", b="contains(text, chr(10) || chr(10))")
query("wn03_adaptive_window", f"WITH {INJ} SELECT doc_id, CASE WHEN {SIZE_SQL} < 2 THEN 1 WHEN {SIZE_SQL} < 4 THEN 2 ELSE 3 END AS size FROM inj")(
    lambda s, d: injected(s, d).withColumn("z", F.when(F.length("text") > 5000, 2).when(F.length("text") > 3000, 1).otherwise(0) + F.col("text").contains('"').cast("int") + F.col("text").contains("\n\n").cast("int")).select("doc_id", F.when(F.col("z") < 2, 1).when(F.col("z") < 4, 2).otherwise(3).alias("size"))
)
BREAKS = "(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL OR length(text) < 60)"


def breaks():
    return F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")).isNull() | (F.length("text") < 60)


query("wn04_candidates_since_break", f"WITH b AS (SELECT *, {BREAKS} AS brk FROM conversations), g AS (SELECT *, max(CASE WHEN brk THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS since FROM b) SELECT conv_id, turn, CAST(greatest(0, least(3, turn - since)) AS BIGINT) AS candidates FROM g")(
    lambda s, d: table(s, d, "conversations").withColumn("brk", breaks()).withColumn("since", F.max(F.when(F.col("brk"), F.col("turn"))).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))).select("conv_id", "turn", F.greatest(F.lit(0), F.least(F.lit(3), F.col("turn") - F.col("since"))).cast("long").alias("candidates"))
)
query("wn05_sentence_context", "SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '') AS context FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", around(F.col("text"), "conv_id", "turn", 2, 2).alias("context"))
)
query("wn06_lines_around_han", f"WITH {LINES}, c AS (SELECT doc_id, no, line, array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), {NL}) AS before, array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), {NL}) AS after FROM l) SELECT doc_id, no, coalesce(before, '') AS before, coalesce(after, '') AS after FROM c WHERE regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]')")(
    lambda s, d: lines_of(s, d).withColumns({"before": F.coalesce(F.array_join(F.collect_list("line").over(W.partitionBy("doc_id").orderBy("no").rowsBetween(-2, -1)), "\n"), F.lit("")), "after": F.coalesce(F.array_join(F.collect_list("line").over(W.partitionBy("doc_id").orderBy("no").rowsBetween(1, 2)), "\n"), F.lit(""))}).where(F.col("line").rlike(r"[\x{4e00}-\x{9fff}]")).select("doc_id", "no", "before", "after")
)
query("wn07_segments", f"SELECT conv_id, turn, CAST(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (SELECT *, {BREAKS} AS brk FROM conversations)")(
    lambda s, d: table(s, d, "conversations").withColumn("brk", breaks()).select("conv_id", "turn", islands(F.col("brk"), "conv_id", "turn").alias("segment"))
)
query("wn08_context_breaks", f"""WITH {INJ}, p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM inj)
    SELECT doc_id, prev IS NOT NULL AND (regexp_matches(substr(text, 1, 200), '(?im)^\\s*(?:Chapter|Chương|Hồi)\\s+\\d+') OR regexp_matches(substr(text, 1, 500), '\\n\\s*\\n\\s*\\n') OR regexp_matches(array_to_string(string_split(text, {NL})[1:5], {NL}), '(?m)^\\s*(?:---|\\*\\*\\*|===)') OR (starts_with(lower({strip('text')}), 'the ') AND NOT contains(lower(right(prev, 200)), 'the '))) AS is_break FROM p""")(
    lambda s, d: context_breaks(s, d)
)


def context_breaks(s, d):
    """A heading early in the text, a scene break, or a topic word at the start that the previous text's end lacks.

    Only two flags a text are ordered, not the texts, and the text before is found by its rank.
    """
    t = F.col("text")
    head = F.substring(t, 1, 200).rlike(r"(?imu)^\s*(?:Chapter|Chương|Hồi)\s+\d+")
    scene = F.substring(t, 1, 500).rlike(r"\n\s*\n\s*\n") | F.array_join(F.slice(X.lines(t), 1, 5), "\n").rlike(r"(?m)^\s*(?:---|\*\*\*|===)")
    flags = injected(s, d).select("doc_id", "source", (head | scene).alias("own"), F.lower(X.strip(t)).startswith("the ").alias("topic"), F.lower(F.right(t, F.lit(200))).contains("the ").alias("ends"))
    placed = group_row_number(flags, "source", ["doc_id"])
    before = placed.select("source", (F.col("k") + 1).alias("k"), F.col("ends").alias("prev_ends"))
    return placed.join(before, ["source", "k"], "left").select("doc_id", (F.col("prev_ends").isNotNull() & (F.col("own") | F.col("topic") & ~F.col("prev_ends"))).alias("is_break"))


query("wn10_position_hint", "SELECT conv_id, turn, CASE WHEN k / n < 0.2 THEN 'top' WHEN k / n > 0.8 THEN 'bottom' ELSE 'middle' END AS hint FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")(
    lambda s, d: table(s, d, "conversations").withColumns({"k": F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1, "n": F.count("*").over(W.partitionBy("conv_id"))}).select("conv_id", "turn", F.when(F.col("k") / F.col("n") < 0.2, "top").when(F.col("k") / F.col("n") > 0.8, "bottom").otherwise("middle").alias("hint"))
)
query("wn11_dependency_lag", "SELECT conv_id, turn, lag(turn, 3) OVER (PARTITION BY conv_id ORDER BY turn) AS waits_for FROM conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.lag("turn", 3).over(W.partitionBy("conv_id").orderBy("turn")).alias("waits_for")))
query("wn12_trailing_requests", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) > 2 AS over_limit FROM events")(
    lambda s, d: trailing_count(table(s, d, "events"), "user_id", "ts", 3600).select("event_id", "n", (F.col("n") > 2).alias("over_limit"))
)
query("wn13_sections", f"WITH {LINES}, {IR}, g AS (SELECT doc_id, no, text, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM ir WHERE {strip('text')} <> '') SELECT doc_id, CAST(section AS BIGINT) AS section, string_agg({strip('text')}, {NL} ORDER BY no) AS body FROM g GROUP BY 1, 2")(
    lambda s, d: structured(s, d).where(X.strip(F.col("text")) != "").withColumn("section", islands(F.col("type") == "heading", "doc_id", "no")).groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("no", X.strip(F.col("text")).alias("t")))).alias("z")).select("doc_id", "section", F.array_join(F.transform("z", lambda x: x["t"]), "\n").alias("body"))
)
SMALL = f"(length({strip('line')}) BETWEEN 1 AND 49)"
query("wn14_small_paragraph_batches", f"WITH {LINES}, f AS (SELECT *, {SMALL} AS small, coalesce(lag({SMALL}) OVER (PARTITION BY doc_id ORDER BY no), FALSE) AS was FROM l), g AS (SELECT *, sum(CASE WHEN small AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS batch FROM f) SELECT doc_id, CAST(batch AS BIGINT) AS batch, count(*) AS n, min(no) AS first_no FROM g WHERE small GROUP BY 1, 2")(
    lambda s, d: lines_of(s, d).withColumn("small", F.length(X.strip(F.col("line"))).between(1, 49)).withColumn("was", F.coalesce(F.lag("small").over(W.partitionBy("doc_id").orderBy("no")), F.lit(False))).withColumn("batch", islands(F.col("small") & ~F.col("was"), "doc_id", "no")).where("small").groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.min("no").alias("first_no"))
)
query("wn15_last_two", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2")(lambda s, d: top_per_key(table(s, d, "conversations"), ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn"))
# Sorts, limits and sets
query("sl01_priority_order", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS place  FROM conversations")(lambda s, d: global_row_number(table(s, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"]))
query("sl02_longest_terms", "SELECT p_type, p_name, k FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY length(p_name) DESC, p_name, p_partkey) AS k FROM part) WHERE k <= 3")(
    lambda s, d: table(s, d, "part").withColumn("k", F.row_number().over(W.partitionBy("p_type").orderBy(F.length("p_name").desc(), "p_name", "p_partkey")).cast("long")).where("k <= 3").select("p_type", "p_name", "k")
)
WORDSET = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda x: x <> ''))"


def word_set(c):
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != ""))


def jaccard(a, b):
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


@query("sl03_context_top2", f"""WITH p AS (SELECT a.conv_id, a.turn, b.turn AS candidate, a.turn - b.turn AS distance, {WORDSET.format('a.text')} AS x, {WORDSET.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1),
    q AS (SELECT conv_id, turn, candidate, 0.6 / distance + 0.4 * coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0) AS score FROM p)
    SELECT conv_id, turn, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, candidate) AS k FROM q) WHERE k <= 2""")
def context_top2(s, d):
    """Two of the three turns before by closeness and shared words; a range join as three shifted equi-joins."""
    c = table(s, d, "conversations").select("conv_id", "turn", word_set(F.col("text")).alias("x"))
    near = c.withColumn("candidate", F.explode(F.sequence(F.col("turn") - 3, F.col("turn") - 1))).join(c.select("conv_id", F.col("turn").alias("candidate"), F.col("x").alias("y")), ["conv_id", "candidate"])
    scored = near.withColumn("score", F.lit(0.6) / (F.col("turn") - F.col("candidate")) + F.lit(0.4) * jaccard(F.col("x"), F.col("y")))
    return top_per_key(scored, ["conv_id", "turn"], [F.desc("score"), F.col("candidate")], 2).select("conv_id", "turn", "candidate", "score")


query("sl04_least_used_key", "SELECT event_type, min_by(user_id, n * 1000000000 + user_id) AS user_id FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")(
    lambda s, d: table(s, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.min_by("user_id", F.struct("n", "user_id")).alias("user_id"))
)
query("sl05_batches", "SELECT source, batch, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 30) AS BIGINT) AS batch FROM documents) GROUP BY 1, 2")(
    lambda s, d: group_row_number(table(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"]).withColumn("batch", F.floor((F.col("k") - 1) / 30).cast("long")).groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
)
query("sl06_first_middle_last", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k = 1 OR k = n OR k = floor(n / 2) + 1")(
    lambda s, d: group_row_number(table(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"]).where("k = 1 or k = n or k = floor(n / 2) + 1").select("source", "doc_id")
)
query("sl07_head_middle_tail", "SELECT doc_id, substr(text, 1, 50) || '|' || substr(text, CAST(floor(length(text) / 2) AS BIGINT) + 1, 50) || '|' || right(text, 50) AS sample FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.concat_ws("|", F.substring("text", 1, 50), F.substring(F.col("text"), F.floor(F.length("text") / 2).cast("int") + 1, F.lit(50)), F.right("text", F.lit(50))).alias("sample"))
)
query("sl09_last_ten", "SELECT source, list(doc_id ORDER BY doc_id)[-10:] AS last_ids FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.desc("doc_id")))).where("k <= 10").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("last_ids"))
)
query("so01_union_of_terms", "SELECT lower(p_brand) AS term FROM part UNION SELECT lower(p_type) FROM part UNION SELECT lower(c_mktsegment) FROM customer")(
    lambda s, d: table(s, d, "part").select(F.lower("p_brand").alias("term")).union(table(s, d, "part").select(F.lower("p_type"))).union(table(s, d, "customer").select(F.lower("c_mktsegment"))).distinct()
)
query("so02_completed_and_failed", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")(
    lambda s, d: table(s, d, "events").where("event_type = 'purchase'").select("user_id").intersect(table(s, d, "events").where("event_type = 'error'").select("user_id"))
)
STOP = ("the", "of", "and", "to", "in", "a", "that", "is")
query("so03_without_stop_words", f"SELECT doc_id, CAST(len(list_filter({WORDSET.format('text')}, lambda x: NOT list_contains({list(STOP)}, x))) AS BIGINT) AS n FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(F.array_except(word_set(F.col("text")), F.array(*map(F.lit, STOP)))).cast("long").alias("n"))
)
SETS = {"words": (WORDSET, word_set), "tokens": ("list_distinct(string_split_regex(trim(lower({0})), '\\s+'))", lambda c: F.array_distinct(F.split(F.trim(F.lower(c)), r"\s+"))), "unicode": ("list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))", lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x != "")))}
for kind, (sql, fn) in SETS.items():
    query(f"so04_jaccard_{kind}", f"WITH p AS (SELECT conv_id, turn, {sql.format('text')} AS x, {sql.format('prev')} AS y FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL) SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS similarity FROM p")(
        lambda s, d, fn=fn: table(s, d, "conversations").withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("prev is not null").select("conv_id", "turn", jaccard(fn(F.col("text")), fn(F.col("prev"))).alias("similarity"))
    )
query("so05_overlap_ratio", f"WITH p AS (SELECT conv_id, turn, {WORDSET.format('prev')} AS o, {WORDSET.format('text')} AS c FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL) SELECT conv_id, turn, CASE WHEN len(o) = 0 THEN 1.0 ELSE len(list_intersect(o, c)) / len(o) END AS overlap, len(o) = 0 OR len(list_intersect(o, c)) / len(o) >= 0.5 AS valid FROM p")(
    lambda s, d: table(s, d, "conversations").withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("prev is not null").withColumns({"o": word_set(F.col("prev")), "c": word_set(F.col("text"))}).withColumn("overlap", F.when(F.size("o") == 0, 1.0).otherwise(F.size(F.array_intersect("o", "c")) / F.size("o"))).select("conv_id", "turn", "overlap", (F.col("overlap") >= 0.5).alias("valid"))
)
query("so06_append_and_sort", "SELECT row_number() OVER (ORDER BY id) AS place, id FROM (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 2 = 1)")(
    lambda s, d: global_row_number(table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id")).unionByName(table(s, d, "documents").where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"))), ["id"])
)
