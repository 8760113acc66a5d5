"""Queries of the string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.plans.inject import INJ, injected
from foliant.registry import query, table

#: SQL pieces shared below; DuckDB's patterns are RE2.
STRIP = r"regexp_replace({0}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


def scalar(name: str, column, sql: str, out: str = "out"):
    """A query that applies one column expression to every injected document."""
    query(name, f"WITH {INJ} SELECT doc_id, {sql} AS {out} FROM inj")(lambda s, d: injected(s, d).select("doc_id", column(F.col("text")).alias(out)))


NL = "chr(10)"
SPLIT = f"string_split(text, {NL})"
BOM = "CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END"
INVISIBLE = "regexp_replace(text, '[\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x{2060}\\x{ad}]', '', 'g')"
URL, EMAIL = r"'https?://[^\s]+'", r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'"


def advanced(x: str) -> str:
    """Line by line: blanks go at a line's end unless an empty line follows."""
    parts = f"string_split(regexp_replace({x}, '\\n{{3,}}', {NL} || {NL}, 'g'), {NL})"
    body = f"(SELECT list_transform(range(1, len(z) + 1), lambda i: CASE WHEN i < len(z) AND (z[i + 1] <> '' OR i + 1 = len(z)) THEN rtrim(z[i], ' ') ELSE z[i] END) FROM (SELECT {parts} AS z))"
    return strip(f"regexp_replace(array_to_string({body}, {NL}), '[ \\t]+', ' ', 'g')")


def punctuation(x: str) -> str:
    x = f"regexp_replace({x}, '[\\s\\x{{3000}}]+([，。！？；：、）】」』》])', '\\1', 'g')"
    x = f"regexp_replace({x}, '([（【「『《])[\\s\\x{{3000}}]+', '\\1', 'g')"
    return f"regexp_replace({x}, '([.!?,;:])([A-Za-z])', '\\1 \\2', 'g')"


def no_repeats(x: str) -> str:
    body = f"(SELECT list_filter(range(1, len(z) + 1), lambda i: i = 1 OR {strip('z[i]')} = '' OR {strip('z[i]')} <> {strip('z[i - 1]')}) FROM (SELECT string_split({x}, {NL}) AS z))"
    return f"array_to_string(list_transform({body}, lambda i: string_split({x}, {NL})[i]), {NL})"


PAGES = f"array_to_string(list_filter({SPLIT}, lambda x: NOT regexp_matches({strip('x')}, '^\\s*(?:第)?\\s*\\d+\\s*(?:页|頁|Page|page|P\\.?)?\\s*$')), {NL})"
LINKS = f"regexp_replace(regexp_replace(text, {URL}, '', 'g'), {EMAIL}, '', 'g')"

scalar("txt01_strip_bom", X.strip_bom, BOM)
query("txt02_remove_invisible", f"WITH {INJ} SELECT doc_id, {INVISIBLE} AS out, length(text) - length({INVISIBLE}) AS removed FROM inj")(
    lambda s, d: injected(s, d).select("doc_id", X.remove_invisible(F.col("text")).alias("out"), (F.length("text") - F.length(X.remove_invisible(F.col("text")))).cast("long").alias("removed"))
)
scalar("txt03_nfc", lambda c: X.nfc(F.concat(c, F.lit("éạ"))), "nfc_normalize(text || 'e' || chr(769) || 'a' || chr(803))")
query("txt04_remove_links", f"WITH {INJ} SELECT doc_id, {LINKS} AS out, CAST(len(regexp_extract_all(text, {URL})) + len(regexp_extract_all(regexp_replace(text, {URL}, '', 'g'), {EMAIL})) AS BIGINT) AS removed FROM inj")(
    lambda s, d: injected(s, d).select("doc_id", X.remove_links(F.col("text")).alias("out"), X.count_links(F.col("text")).cast("long").alias("removed"))
)
scalar("txt05_basic_whitespace", X.basic_whitespace, strip(f"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '[ \\t]+', ' ', 'g'), {NL}), lambda x: {strip('x')}), {NL}), '\\n{{3,}}', {NL} || {NL}, 'g')"))
scalar("txt06_advanced_whitespace", X.advanced_whitespace, advanced("text"))
scalar("txt07_punctuation_spacing", X.punctuation_spacing, punctuation("text"))
CLEAN_SAFE = f"WITH {INJ}, a AS (SELECT doc_id, nfc_normalize({INVISIBLE.replace('text', '(' + BOM + ')')}) AS text FROM inj), b AS (SELECT doc_id, {LINKS} AS text FROM a), p AS (SELECT doc_id, {PAGES} AS paged, text FROM b), c AS (SELECT doc_id, SPACED AS text FROM p), e AS (SELECT doc_id, {punctuation('text')} AS text FROM c) SELECT doc_id, {no_repeats('text')} AS out FROM e"
query("txt08_clean_safe", CLEAN_SAFE.replace("SPACED", advanced("text")))(lambda s, d: X.clean_documents(injected(s, d)).select("doc_id", F.col("text").alias("out")))
query("txt08_clean_aggressive", CLEAN_SAFE.replace("SPACED", advanced("paged")))(lambda s, d: X.clean_documents(injected(s, d), "aggressive").select("doc_id", F.col("text").alias("out")))
query("txt08_clean_technical", f"WITH {INJ}, a AS (SELECT doc_id, nfc_normalize({INVISIBLE.replace('text', '(' + BOM + ')')}) AS text FROM inj), c AS (SELECT doc_id, {advanced('text')} AS text FROM a) SELECT doc_id, {no_repeats('text')} AS out FROM c")(
    lambda s, d: X.clean_documents(injected(s, d), "domain_technical").select("doc_id", F.col("text").alias("out"))
)
CJKW = r"\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}"
COUNT = "length(regexp_replace(text, '{0}', '', 'g'))"
N_CJK = f"(length(text) - {COUNT.format('[' + CJKW + ']')})"
N_SPACE = f"(length(text) - {COUNT.format('[' + chr(92) + 's]')})"
N_WORD = f"(length(text) - {COUNT.format('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} - {N_CJK})"
WEIGHTED = f"CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(({N_CJK} * 4 + {N_SPACE} + {N_WORD} + (length(text) - {N_CJK} - {N_SPACE} - {N_WORD}) * 2) / 4.0)) END AS BIGINT)"
scalar("txt09_weighted_tokens", X.weighted_tokens, WEIGHTED, "tokens")
scalar("txt10_simple_tokens", X.simple_tokens, "CAST(floor(length(text) / 4.0) AS BIGINT)", "tokens")
scalar("txt11_cjk_tokens", X.cjk_tokens, f"CAST(floor({N_CJK} * 1.5 + (length(text) - {N_CJK}) / 4.0) AS BIGINT)", "tokens")
query(
    "txt12_paragraphs",
    f"""WITH {INJ}, l AS (SELECT doc_id, unnest({SPLIT}) AS line, generate_subscripts({SPLIT}, 1) AS no FROM inj),
    b AS (SELECT *, {strip('line')} = '' AS blank, sum(CASE WHEN {strip('line')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS grp FROM l),
    p AS (SELECT doc_id, min(no) AS pos, string_agg(line, {NL} ORDER BY no) AS text FROM b WHERE NOT blank GROUP BY doc_id, grp UNION ALL SELECT doc_id, no, '' FROM b WHERE blank)
    SELECT doc_id, count(*) AS n, string_agg({strip('text')}, {NL} ORDER BY pos) AS out FROM p GROUP BY doc_id""",
)(lambda s, d: injected(s, d).withColumn("p", X.paragraphs(F.col("text"))).select("doc_id", F.size("p").cast("long").alias("n"), X.join_paragraphs(F.col("p")).alias("out")))
ENDS = " OR ".join(f"ends_with(lower(x), '{w}')" for w in X.CONJUNCTIONS)
query(
    "txt13_incomplete_paragraphs",
    f"""WITH {INJ}, l AS (SELECT doc_id, {strip('x')} AS x FROM (SELECT doc_id, unnest({SPLIT}) AS x FROM inj))
    SELECT doc_id, count(*) FILTER (x <> '' AND NOT contains('{X.COMPLETE_ENDS}', x[-1:]) AND (contains('{X.INCOMPLETE_ENDS}', x[-1:]) OR length(x) < 30 OR {ENDS})) AS n FROM l GROUP BY doc_id""",
)(lambda s, d: injected(s, d).select("doc_id", F.size(F.filter(X.lines(F.col("text")), X.is_incomplete)).cast("long").alias("n")))
SENT = f"list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？]*[.!?。！？]?'), lambda x: {strip('x')}), lambda x: x <> '')"
query("txt15_sentences", f"WITH {INJ} SELECT doc_id, generate_subscripts(z, 1) - 1 AS no, unnest(z) AS sentence FROM (SELECT doc_id, {SENT} AS z FROM inj)")(
    lambda s, d: injected(s, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("no", "sentence")).withColumn("no", F.col("no").cast("long"))
)
query(
    "txt19_chapters",
    f"""WITH {INJ}, l AS (SELECT doc_id, unnest({SPLIT}) AS line, generate_subscripts({SPLIT}, 1) AS no FROM inj),
    h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '(?i)^(?:(?:Chương|Chapter|Hồi|Quyển|Book|Vol|Volume)\\s+\\d+|\\d+\\.\\s+(?:Chương|Chapter)|Đệ\\s+\\d+\\s+Chương|第\\s*\\d+\\s*章)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS chapter FROM l)
    SELECT doc_id, CAST(chapter AS BIGINT) AS chapter, CASE WHEN chapter = 0 THEN 'Intro' ELSE {strip('min_by(line, no)')} END AS title, string_agg(line, {NL} ORDER BY no) AS body FROM h GROUP BY doc_id, chapter""",
)(lambda s, d: chapters(injected(s, d)))


def chapters(docs):
    """(doc_id, chapter, title, body): lines from one heading to the next; chapter 0 is what stands before any."""
    from foliant.operators.lines import explode_lines

    from pyspark.sql import Window as W

    rows = explode_lines(docs)
    w = W.partitionBy("doc_id").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("chapter", F.sum(X.is_heading(F.col("line")).cast("int")).over(w))
    grouped = rows.groupBy("doc_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("z"))
    title = F.when(F.col("chapter") == 0, "Intro").otherwise(X.strip(F.col("z")[0]["line"]))
    return grouped.select("doc_id", "chapter", title.alias("title"), F.array_join(F.transform("z", lambda x: x["line"]), "\n").alias("body"))


query("txt20_wrap_markers", f"WITH {INJ} SELECT doc_id, '[CHUNK:' || doc_id || ':START]' || {NL} || text || {NL} || '[CHUNK:' || doc_id || ':END]' AS out FROM inj")(
    lambda s, d: injected(s, d).select("doc_id", X.wrap_markers(F.col("text"), F.col("doc_id")).alias("out"))
)
query("txt21_strip_markers", f"WITH {INJ} SELECT doc_id, {strip('text')} AS out FROM inj")(lambda s, d: injected(s, d).select("doc_id", X.strip_markers(X.wrap_markers(F.col("text"), F.col("doc_id"))).alias("out")))
METRICS = f"""m AS (SELECT doc_id, text, count(x) AS n, coalesce(sum(length(x)), 0) AS total, count(*) FILTER (length(x) < 8) AS short, count(*) FILTER ((length(x) - length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'))) / length(x) > 0.45) AS noisy
  FROM (SELECT doc_id, text, unnest(list_filter(list_transform({SPLIT}, lambda x: {strip('x')}), lambda x: x <> '')) AS x FROM inj) GROUP BY doc_id, text)"""
query(
    "txt22_scan_gate",
    f"""WITH {INJ}, {METRICS} SELECT doc_id, CAST(n AS DOUBLE) AS line_count, total / n AS avg_line_length, short / n AS short_line_ratio, noisy / n AS noisy_line_ratio,
    CASE WHEN length({strip('text')}) < 800 THEN 'below_min_chars' WHEN total / n < 24 THEN 'avg_line_too_short' WHEN short / n > 0.55 THEN 'too_many_short_lines' WHEN noisy / n > 0.25 THEN 'too_noisy' ELSE 'passed' END AS reason FROM m""",
)(lambda s, d: injected(s, d).select("doc_id", X.scan_metrics(F.col("text")).alias("m"), X.scan_gate(F.col("text")).alias("reason")).select("doc_id", "m.*", "reason"))
MD = r"'(?i)^(?:(?:Chapter|Chương|Hồi|Quyển)\s+\S+.*|第.+章.*)$'"
TAGGED = "'[H1]Title ' || doc_id || '[/H2]' || chr(10) || '[ H2 ]Part' || chr(10) || text || chr(10) || '[H3]x[/H3]'"
scalar("txt24_heading_tags", lambda c: X.tags_to_markdown(F.concat(F.lit("[H1]Title[/H2]\n[ H2 ]Part\n"), c, F.lit("\n[H3]x[/H3]"))), f"'# Title' || {NL} || '## Part ' || {NL} || text || {NL} || '### x'")
query("txt32_bisect", f"""WITH {INJ}, m AS (SELECT doc_id, text, CAST(floor(length(text) / 2) AS BIGINT) AS mid FROM inj),
    w AS (SELECT *, greatest(0, mid - 2000) AS low, substr(text, CAST(greatest(0, mid - 2000) + 1 AS BIGINT), CAST(least(length(text), mid + 2000) - greatest(0, mid - 2000) AS BIGINT)) AS win FROM m),
    c AS (SELECT doc_id, text, CASE WHEN contains(win, {NL}) THEN low + length(win) - strpos(reverse(win), {NL}) ELSE mid END AS cut FROM w)
    SELECT doc_id, {strip('substr(text, 1, CAST(cut AS BIGINT))')} AS first, {strip('substr(text, CAST(cut AS BIGINT) + 1)')} AS second FROM c""")(
    lambda s, d: injected(s, d).select("doc_id", X.bisect(F.col("text")).alias("b")).select("doc_id", "b.*")
)
FOREIGN = {"han": r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}]", "thai": r"[\x{0e00}-\x{0e7f}]", "hangul": r"[\x{ac00}-\x{d7af}]", "kana": r"[\x{3040}-\x{30ff}]"}
query("txt33_foreign_scripts", f"WITH {INJ} SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {n}" for n, p in FOREIGN.items()) + " FROM inj")(
    lambda s, d: injected(s, d).select("doc_id", *[F.regexp_count(F.col("text"), F.lit(p)).cast("long").alias(n) for n, p in FOREIGN.items()])
)
query("txt34_han_runs", f"WITH {INJ}, r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{f900}}-\\x{{faff}}]+')) AS run FROM inj) SELECT doc_id, string_agg(run, ',' ORDER BY length(run) DESC, run) AS runs FROM r GROUP BY doc_id")(
    lambda s, d: injected(s, d).select("doc_id", X.han_runs(F.col("text")).alias("z")).where("size(z) > 0").select("doc_id", F.array_join("z", ",").alias("runs"))
)
scalar("txt39_tidy_spacing", lambda c: X.strip_text_ids(X.tidy_spacing(F.concat(c, F.lit(" ( a )  , \" b \"[TX:c1-0001]!")))), "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' ( a )  , \" b \"[TX:c1-0001]!', '  +', ' ', 'g'), ' +([,\\.。!?;:！？，])', '\\1', 'g'), '\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g'), '\"\\s+', '\"', 'g'), '\\s+\"', '\"', 'g'), '\\[TX:[^\\]]+\\]', '', 'g')")
BLANKS = r"regexp_replace(x, '[ \t]+', ' ', 'g')"
scalar("txt40_minify", X.minify, f"(SELECT array_to_string(list_transform(list_filter(range(1, len(z) + 1), lambda i: z[i] <> '' OR i = 1 OR z[i - 1] <> ''), lambda i: z[i]), {NL}) FROM (SELECT list_transform(string_split({strip('text')}, {NL}), lambda x: {strip(BLANKS)}) AS z))")
scalar("txt40_minify_context", X.minify_context, f"array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({strip('text')}, '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '__([^_]+)__', '\\1', 'g'), {NL}), lambda x: {strip('x')}), lambda x: x <> ''), {NL})")
scalar("txt42_strip_diacritics", lambda c: X.strip_diacritics(F.regexp_replace(c, "[^\\x{00}-\\x{ff}]", "")), "strip_accents(regexp_replace(text, '[^\\x{00}-\\x{ff}]', '', 'g'))")
scalar("txt43_collapse", X.collapse, "regexp_replace(" + strip("text") + r", '[\s\x{3000}]+', ' ', 'g')")
query("txt44_keys_and_masks", f"WITH {INJ} SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, '...' || right(source, 4) AS masked FROM inj")(
    lambda s, d: injected(s, d).select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), X.mask_key(F.col("source")).alias("masked"))
)
