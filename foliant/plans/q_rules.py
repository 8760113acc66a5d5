"""Queries of scores, classifiers, parsers, dates and the small operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.functions import text as X
from foliant.operators.windows import group_row_number, running_past, top_per_key
from foliant.plans.inject import INJ, injected
from foliant.plans.q_aggregates import MESSAGE_SQL, messages
from foliant.plans.q_text import NL, strip
from foliant.registry import query, table

EMOTIONAL, POETIC = ("love", "anger", "hand"), ("moon", "the", "wind")


def occurrences(x: str, words) -> str:
    return "(" + " + ".join(f"CAST((length({x}) - length(replace({x}, '{w}', ''))) / {len(w)} AS INTEGER)" for w in words) + ")"


QUOTES = occurrences("text", ['"'])
query("mth01_complexity", f"WITH {INJ} SELECT doc_id, least(100, least(30, (doc_id % 9) * 5) + least(40, 8 * {occurrences('text', EMOTIONAL)}) + CASE WHEN 2 * {QUOTES} > 4 THEN 15 ELSE 0 END + least(15, 3 * {occurrences('text', POETIC)})) AS score FROM inj")(
    lambda s, d: injected(s, d).select("doc_id", R.complexity(F.col("text"), F.col("doc_id") % 9, EMOTIONAL, POETIC).cast("long").alias("score"))
)
WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''))"
query("mth02_word_ratio", f"WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) SELECT conv_id, turn, CAST({WORDS.format('text')} AS BIGINT) AS words, {WORDS.format('text')} / {WORDS.format('prev')} AS ratio FROM p WHERE prev IS NOT NULL AND {WORDS.format('prev')} > 0")(
    lambda s, d: table(s, d, "conversations").withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("prev is not null").withColumns({"a": F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")), "b": F.size(F.filter(F.split("prev", r"\s+"), lambda x: x != ""))}).where("b > 0").select("conv_id", "turn", F.col("a").cast("long").alias("words"), (F.col("a") / F.col("b")).alias("ratio"))
)
query("mth03_adaptive_timeout", "WITH h AS (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM events) SELECT event_id, CAST(round(greatest(30.0, least(600.0, 0.7 * (60 + value / 1000 * 2) + 0.3 * coalesce(past * 1.5, 60.0))) * 1000) AS BIGINT) AS timeout_ms FROM h")(
    lambda s, d: running_past(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value").select("event_id", F.round(F.greatest(F.lit(30.0), F.least(F.lit(600.0), 0.7 * (60 + F.col("value") / 1000 * 2) + 0.3 * F.coalesce(F.col("past_mean") * 1.5, F.lit(60.0)))) * 1000).cast("long").alias("timeout_ms"))
)
KIND_SQL = "CASE WHEN contains(lower(m), 'resource_exhausted') OR contains(lower(m), 'quota') THEN 'quota_exceeded' WHEN contains(lower(m), 'rate_limit') OR contains(lower(m), 'too many requests') THEN 'rate_limit' WHEN contains(lower(m), 'api key') AND (contains(lower(m), 'not valid') OR contains(lower(m), 'invalid')) OR regexp_matches(lower(m), 'invalid_api_key| 401|401 | 403|403 ') THEN 'invalid_key' WHEN regexp_matches(lower(m), 'timeout|deadline') THEN 'timeout' WHEN regexp_matches(lower(m), 'safety|blocked') THEN 'generation_blocked' WHEN starts_with(m, '5') OR regexp_matches(lower(m), 'internal|server error') THEN 'server_error' ELSE 'unknown' END"
query("cls02_error_class", f"SELECT event_id, {KIND_SQL} AS kind FROM {MESSAGE_SQL}")(lambda s, d: messages(s, d).select("event_id", R.error_class(F.col("m"), F.lit("Exception")).alias("kind")))
query("mth04_cooldown", f"""SELECT event_id, CASE WHEN (kind = 'rate_limit' OR contains(m, '429')) AND regexp_matches(lower(m), 'retry\\s*after[:\\s]*\\d+\\.?\\d*\\s*s') THEN CAST(floor(CAST(regexp_extract(lower(m), 'retry\\s*after[:\\s]*(\\d+\\.?\\d*)\\s*s', 1) AS DOUBLE)) AS INTEGER) + 1
    WHEN (kind = 'quota_exceeded' OR contains(lower(m), 'quota')) AND (event_id % 6 >= 3 OR contains(lower(m), 'daily')) THEN 86400
    WHEN kind IN ('server_error', 'timeout') THEN CASE kind WHEN 'timeout' THEN 10 ELSE 30 END * ([1, 2, 4, 8, 16])[least(event_id % 6, 4) + 1] ELSE CASE kind WHEN 'rate_limit' THEN 15 ELSE 60 END END AS seconds FROM (SELECT event_id, m, {KIND_SQL} AS kind FROM {MESSAGE_SQL})""")(
    lambda s, d: messages(s, d).withColumn("kind", R.error_class(F.col("m"), F.lit("Exception"))).select("event_id", R.cooldown(F.col("kind"), F.col("event_id") % 6, F.col("m")).cast("int").alias("seconds"))
)
query("mth05_dynamic_delay", "SELECT user_id, CASE WHEN q / n > 0.5 THEN CAST(floor(60 * (1.5 + (q / n - 0.5) * 2)) AS BIGINT) ELSE 60 END AS delay FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS q, count(*) AS n FROM events GROUP BY user_id)")(
    lambda s, d: table(s, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") / F.count("*")).alias("r")).select("user_id", F.when(F.col("r") > 0.5, F.floor(60 * (1.5 + (F.col("r") - 0.5) * 2)).cast("long")).otherwise(60).alias("delay"))
)
query("mth06_worker_allocation", "SELECT chunks, keys, least(chunks, floor(keys * tr))::BIGINT AS translation, least(chunks, floor(keys * er))::BIGINT AS editor, greatest(1, keys - least(chunks, floor(keys * tr)) - least(chunks, floor(keys * er)))::BIGINT AS reserve FROM (SELECT user_id AS chunks, count(*) AS keys, CASE WHEN user_id >= count(*) THEN 0.7::DOUBLE ELSE user_id::DOUBLE / count(*) * 0.7::DOUBLE END AS tr, CASE WHEN user_id >= count(*) THEN 0.2::DOUBLE ELSE user_id::DOUBLE / count(*) * 0.2::DOUBLE END AS er FROM events GROUP BY user_id)")(
    lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("chunks")).agg(F.count("*").alias("keys")).withColumn("r", F.least(F.lit(1.0), F.col("chunks") / F.col("keys"))).withColumns({"t": F.floor(F.col("keys") * (F.col("r") * 0.7)).cast("long"), "e": F.floor(F.col("keys") * (F.col("r") * 0.2)).cast("long")}).withColumns({"translation": F.least("chunks", "t"), "editor": F.least("chunks", "e")}).select("chunks", "keys", "translation", "editor", F.greatest(F.lit(1).cast("long"), F.col("keys") - F.col("translation") - F.col("editor")).alias("reserve"))
)
query("mth07_throughput_factor", "SELECT user_id, greatest(1, CAST(floor(8 * (CASE WHEN ok < 0.8 THEN 0.5 WHEN ok < 0.95 THEN 0.75 ELSE 1.0 END)::DOUBLE * (CASE WHEN q > 0.1 THEN 0.3 WHEN q > 0.05 THEN 0.5 ELSE 1.0 END)::DOUBLE) AS BIGINT)) AS workers FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') / count(*) AS ok, count(*) FILTER (event_type = 'purchase') / count(*) AS q FROM events GROUP BY user_id)")(
    lambda s, d: table(s, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") != "error") / F.count("*")).alias("ok"), (F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("q")).select("user_id", F.greatest(F.lit(1).cast("long"), F.floor(8 * F.when(F.col("ok") < 0.8, 0.5).when(F.col("ok") < 0.95, 0.75).otherwise(1.0) * F.when(F.col("q") > 0.1, 0.3).when(F.col("q") > 0.05, 0.5).otherwise(1.0)).cast("long")).alias("workers"))
)
query("mth08_adaptive_limit", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'flash') THEN 25000 WHEN contains(lower(p_name), 'pro') THEN 12000 ELSE 10000 END AS max_tokens FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Flash ' WHEN 1 THEN 'Pro ' ELSE '' END || p_name AS p_name FROM part)")(
    lambda s, d: table(s, d, "part").withColumn("n", F.lower(F.concat(F.when(F.col("p_partkey") % 3 == 0, "Flash ").when(F.col("p_partkey") % 3 == 1, "Pro ").otherwise(""), F.col("p_name")))).select("p_partkey", F.when(F.col("n").contains("flash"), 25000).when(F.col("n").contains("pro"), 12000).otherwise(10000).alias("max_tokens"))
)
query("mth09_confidence", "SELECT doc_id, (CASE WHEN contains(text, 'the') THEN 0.4 ELSE 0 END)::DOUBLE + (CASE WHEN contains(text, chr(10)) THEN 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN length(text) > 500 THEN 0.2 ELSE 0 END)::DOUBLE AS confidence FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", (F.when(F.col("text").contains("the"), 0.4).otherwise(0.0) + F.when(F.col("text").contains("\n"), 0.3).otherwise(0.0) + F.when(F.length("text") > 500, 0.2).otherwise(0.0)).alias("confidence"))
)
query("mth10_priority", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END + CASE WHEN length(text) > 200 THEN 2 ELSE 1 END AS priority FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", (F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 2).otherwise(1) + F.when(F.length("text") > 200, 2).otherwise(1)).alias("priority"))
)
CONTEXTS = (("battle", "anger"), ("house", "home"), ("hand", "touch"), ("the", "plain"))
query("cls01_context", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{c}'" for w, c in CONTEXTS) + " ELSE 'none' END AS context FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(*[F.when(F.lower("text").contains(w), F.lit(c)) for w, c in CONTEXTS], F.lit("none")).alias("context"))
)
PATTERN_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(m), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in R.ERROR_PATTERNS.items()) + " ELSE 'unknown' END"
query("cls03_error_pattern", f"SELECT event_id, {PATTERN_SQL} AS kind FROM {MESSAGE_SQL}")(lambda s, d: messages(s, d).select("event_id", R.error_pattern_class(F.col("m"), F.lit("Exception")).alias("kind")))
query("cls04_service_error", f"SELECT event_id, CASE WHEN regexp_matches(lower(m), '429|quota|resourceexhausted|resource exhausted|rate limit') THEN 'quota_exceeded' WHEN regexp_matches(m, '401|403') THEN 'invalid_key' WHEN regexp_matches(lower(m), 'timeout|deadline exceeded|connection|network|unavailable|503|502|500') THEN 'network_error' ELSE 'generation_error' END AS kind FROM {MESSAGE_SQL}")(
    lambda s, d: messages(s, d).select("event_id", R.service_error_class(F.col("m")).alias("kind"))
)
query("cls05_quota_error", f"SELECT event_id, regexp_matches(m, '429') OR regexp_matches(lower(m), 'resource_exhausted|quota|rate limit') AS is_quota FROM {MESSAGE_SQL}")(lambda s, d: messages(s, d).select("event_id", R.is_quota_error(F.col("m")).alias("is_quota")))
query("cls06_account_type", f"SELECT event_id, CASE WHEN regexp_matches(lower(m), 'permission|api_key_invalid') THEN CASE WHEN regexp_matches(lower(m), 'access denied|region|not available') THEN 'restricted' ELSE 'unknown' END WHEN regexp_matches(lower(m), '429|resource_exhausted|quota|rate limit') THEN CASE WHEN regexp_matches(lower(m), 'billing|payment') THEN 'paid_tier_required' ELSE 'free_tier' END WHEN regexp_matches(lower(m), 'billing|payment') THEN 'paid_tier_required' ELSE 'unknown' END AS account FROM {MESSAGE_SQL}")(
    lambda s, d: (lambda m: messages(s, d).select("event_id", F.when(R.has(m, "permission", "api_key_invalid"), F.when(R.has(m, "access denied", "region", "not available"), "restricted").otherwise("unknown")).when(R.has(m, "429", "resource_exhausted", "quota", "rate limit"), F.when(R.has(m, "billing", "payment"), "paid_tier_required").otherwise("free_tier")).when(R.has(m, "billing", "payment"), "paid_tier_required").otherwise("unknown").alias("account")))(F.lower("m"))
)
query("cls07_style", f"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: {strip('x')}), lambda x: x <> '') AS z FROM documents), w AS (SELECT doc_id, len(z) AS n, list_sum(list_transform(z, lambda x: len(string_split_regex(x, '\\s+')))) / len(z) AS m FROM p WHERE len(z) > 0) SELECT doc_id, CASE WHEN m < 15 THEN 'nhanh' WHEN m < 25 THEN 'trung bình' ELSE 'chậm' END AS pace, round_even(m, 1) AS avg_length, n AS sentence_count FROM w")(
    lambda s, d: table(s, d, "documents").select("doc_id", R.style_basics(F.col("text")).alias("z")).where("z is not null").select("doc_id", "z.*").withColumn("sentence_count", F.col("sentence_count").cast("long"))
)
query("cls08_primary_pronoun", "SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split(term, '/'), lambda x: trim(x)), lambda x: lower(x) IN ('he', 'she', 'i'))[1], term) AS pronoun FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'lord / He' WHEN 1 THEN 'lady/she' ELSE 'they' END AS term FROM conversations)")(
    lambda s, d: table(s, d, "conversations").withColumn("term", F.when(F.col("turn") % 3 == 0, "lord / He").when(F.col("turn") % 3 == 1, "lady/she").otherwise("they")).select("conv_id", "turn", F.coalesce(F.get(F.filter(F.transform(F.split("term", "/"), lambda x: F.trim(x)), lambda x: F.lower(x).isin("he", "she", "i")), F.lit(0)), F.col("term")).alias("pronoun"))
)
GRID = {"context": ("public", "private", "battle"), "formality": ("formal", "polite", "plain", "rude"), "emotion": ("joy", "anger", "fear", "love", "sad", "calm"), "scene": ("home", "court", "road", "war", "dream")}


@query("cls09_rule_grid", "SELECT " + ", ".join(GRID) + " FROM " + ", ".join(f"(SELECT unnest({list(v)}) AS {k})" for k, v in GRID.items()))
def rule_grid(s, d):
    """All combinations of four fixed lists."""
    out = s.range(1).drop("id")
    for name, values in GRID.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


query("cls10_dialogue", "SELECT doc_id, unnest(regexp_extract_all(t, '\"([^\"]*)\"', 1)) AS speech FROM (SELECT doc_id, text || ' \"Stop!\" they said. \"Go ' || doc_id || '\"' AS t FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.concat("text", F.lit(' "Stop!" they said. "Go '), F.col("doc_id").cast("string"), F.lit('"')), F.lit('"([^"]*)"'), F.lit(1))).alias("speech"))
)
query("cls11_model_choice", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'flash' WHEN 1 THEN 'pro' ELSE CASE WHEN doc_id % 100 >= 70 THEN 'pro' ELSE 'flash' END END AS model FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "flash").when(F.col("doc_id") % 3 == 1, "pro").when(F.col("doc_id") % 100 >= 70, "pro").otherwise("flash").alias("model"))
)
query("txt26_heading_class", f"""WITH h AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Chapter ' || p_partkey WHEN 1 THEN '1.' || p_partkey || ' x' WHEN 2 THEN 'Section ' || p_size WHEN 3 THEN 'Chương hai' WHEN 4 THEN '第' || p_size || '章' WHEN 5 THEN 'Subsection ' || p_size ELSE p_name END AS t FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)^(?:第?\\s*\\d+\\s*章|chapter\\s+\\d+|Chương\\s+[A-Za-z0-9]+)') THEN 'chapter' WHEN regexp_matches(t, '(?i)^(?:第?\\s*\\d+[.、]\\s*\\d+|section\\s+\\d+)') THEN 'section' WHEN regexp_matches(t, '(?i)^subsection\\s+\\d+') THEN 'subsection' WHEN length(t) < 80 THEN 'subsection' ELSE 'unknown' END AS kind FROM h""")(
    lambda s, d: table(s, d, "part").withColumn("t", (lambda k: F.when(k == 0, F.concat(F.lit("Chapter "), F.col("p_partkey").cast("string"))).when(k == 1, F.concat(F.lit("1."), F.col("p_partkey").cast("string"), F.lit(" x"))).when(k == 2, F.concat(F.lit("Section "), F.col("p_size").cast("string"))).when(k == 3, "Chương hai").when(k == 4, F.concat(F.lit("第"), F.col("p_size").cast("string"), F.lit("章"))).when(k == 5, F.concat(F.lit("Subsection "), F.col("p_size").cast("string"))).otherwise(F.col("p_name")))(F.col("p_partkey") % 7)).select("p_partkey", R.heading_class(F.col("t")).alias("kind"))
)
query("src01_format_dispatch", "SELECT page_id, CASE lower(regexp_extract(u, '(\\.[A-Za-z]+)$', 1)) WHEN '.txt' THEN 'text' WHEN '.epub' THEN 'epub' WHEN '.docx' THEN 'docx' WHEN '.pdf' THEN 'pdf' ELSE 'unsupported' END AS format FROM (SELECT page_id, url || ([ '.TXT', '.epub', '.docx', '.pdf', '.doc'])[page_id % 5 + 1] AS u FROM pages)")(
    lambda s, d: table(s, d, "pages").withColumn("x", F.lower(F.regexp_extract(F.concat("url", F.element_at(F.array(*map(F.lit, (".TXT", ".epub", ".docx", ".pdf", ".doc"))), (F.col("page_id") % 5 + 1).cast("int"))), r"(\.[A-Za-z]+)$", 1))).select("page_id", F.when(F.col("x") == ".txt", "text").when(F.col("x") == ".epub", "epub").when(F.col("x") == ".docx", "docx").when(F.col("x") == ".pdf", "pdf").otherwise("unsupported").alias("format"))
)
query("src09_scan_classifier", "SELECT source, sum(length(trim(text))) FILTER (k = 1 OR k = n OR k = floor(n / 2) + 1) > 200 AS has_text FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source")(
    lambda s, d: group_row_number(table(s, d, "documents").select("source", "doc_id", F.length(F.trim("text")).alias("size")), "source", ["doc_id"]).where("k = 1 or k = n or k = floor(n / 2) + 1").groupBy("source").agg((F.sum("size") > 200).alias("has_text"))
)
SPEC = "CASE event_id % 4 WHEN 0 THEN '1-3,7,' || user_id WHEN 1 THEN '[' || user_id || ', x, 5-2, 4-6]' WHEN 2 THEN ' ' ELSE '2,2,1' END"
query("src12_page_ranges", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN list_sort(list_distinct([1, 2, 3, 7] || CASE WHEN user_id > 0 THEN [user_id] ELSE [] END)) WHEN 1 THEN list_sort(list_distinct([4, 5, 6] || CASE WHEN user_id > 0 THEN [user_id] ELSE [] END)) WHEN 2 THEN NULL ELSE [1, 2] END AS pages FROM events")(
    lambda s, d: table(s, d, "events").withColumn("spec", (lambda k, u: F.when(k == 0, F.concat(F.lit("1-3,7,"), u)).when(k == 1, F.concat(F.lit("["), u, F.lit(", x, 5-2, 4-6]"))).when(k == 2, " ").otherwise("2,2,1"))(F.col("event_id") % 4, F.col("user_id").cast("string"))).select("event_id", R.page_ranges(F.col("spec")).cast("array<bigint>").alias("pages"))
)
# JSON and CSV
query("jsn01_fenced_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(R.strip_fences(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))), "$.k", "int").alias("k"))
)
query("jsn02_array_in_prose", "SELECT event_id, user_id AS id, event_type AS old, upper(event_type) AS new FROM events")(
    lambda s, d: table(s, d, "events").withColumn("reply", F.concat(F.lit('Here it is: [ {"id": '), F.col("user_id").cast("string"), F.lit(', "old": "'), F.col("event_type"), F.lit('", "new": "'), F.upper("event_type"), F.lit('"} ] done'))).select("event_id", F.explode(F.from_json(F.regexp_extract("reply", r"(?s)\[\s*\{.*\}\s*\]", 0), "array<struct<id:bigint,old:string,new:string>>")).alias("x")).select("event_id", "x.*")
)
query("jsn03_required_keys", "SELECT event_id, list_contains(json_keys(props), 'k') AS complete FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.coalesce(F.array_contains(F.json_object_keys("props"), "k"), F.lit(False)).alias("complete")))
PAIRS = (("the", "THE"), ("THEre", "there"), ("of", "OF"))
query("jsn04_sequential_replace", "SELECT doc_id, replace(replace(replace(text, 'the', 'THE'), 'THEre', 'there'), 'of', 'OF') AS out FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.aggregate(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS]), F.col("text"), lambda t, p: F.replace(t, p["a"], p["b"])).alias("out"))
)
CSV = "'Type,Original_Term_CN,Translated_Term_VI' || chr(10) || p_type || ',' || p_name || ',x' || CASE WHEN p_partkey % 4 = 0 THEN ',extra' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE chr(10) || '// note' || chr(10) || p_brand || ',' || p_size || ',y' END"


def csv_text(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("Type,Original_Term_CN,Translated_Term_VI\n"), "p_type", F.lit(","), "p_name", F.lit(",x"), F.when(k % 4 == 0, ",extra").otherwise(""), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("\n// note\n"), "p_brand", F.lit(","), F.col("p_size").cast("string"), F.lit(",y")))).alias("csv"))


query("csv01_quality_check", f"SELECT p_partkey, CASE WHEN len(list_filter(string_split(csv, {NL}), lambda x: trim(x) <> '')) < 2 THEN 'too_short' WHEN NOT contains(lower(string_split(csv, {NL})[1]), 'translated_term_vi') THEN 'missing' ELSE 'ok' END AS verdict FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'Type' ELSE {CSV} END AS csv FROM part)")(
    lambda s, d: csv_text(s, d).withColumn("csv", F.when(F.col("p_partkey") % 6 == 0, "Type").otherwise(F.col("csv"))).select("p_partkey", F.when(F.size(F.filter(X.lines(F.col("csv")), lambda x: F.trim(x) != "")) < 2, "too_short").when(~F.lower(X.lines(F.col("csv"))[0]).contains("translated_term_vi"), "missing").otherwise("ok").alias("verdict"))
)
query("flt15_csv_lines", f"SELECT p_partkey, unnest(list_filter(string_split(csv, {NL}), lambda x: contains(x, ',') AND NOT starts_with(x, '//') AND len(string_split(x, ',')) = 3)) AS line FROM (SELECT p_partkey, {CSV} AS csv FROM part)")(
    lambda s, d: csv_text(s, d).select("p_partkey", F.explode(F.filter(X.lines(F.col("csv")), lambda x: x.contains(",") & ~x.startswith("//") & (F.size(F.split(x, ",")) == 3))).alias("line"))
)
query("csv02_merge_parts", f"SELECT p_brand, count(*) AS n FROM (SELECT p_brand, unnest(string_split({CSV}, {NL})) AS line FROM part) WHERE line <> 'Type,Original_Term_CN,Translated_Term_VI' AND trim(line) <> '' GROUP BY 1")(
    lambda s, d: csv_text(s, d).join(table(s, d, "part").select("p_partkey", "p_brand"), "p_partkey").select("p_brand", F.explode(X.lines(F.col("csv"))).alias("line")).where("line <> 'Type,Original_Term_CN,Translated_Term_VI' and trim(line) <> ''").groupBy("p_brand").agg(F.count("*").alias("n"))
)
query("csv03_repair_lines", f"SELECT p_partkey, array_to_string(list_transform(range(1, len(z) + 1), lambda i: CASE WHEN i = 1 THEN z[1] WHEN i = 2 THEN 'fixed' ELSE trim(z[i]) END), {NL}) AS out FROM (SELECT p_partkey, string_split({CSV}, {NL}) AS z FROM part)")(
    lambda s, d: csv_text(s, d).withColumn("z", X.lines(F.col("csv"))).withColumn("fixed", F.array(F.lit("fixed"))).select("p_partkey", F.array_join(F.concat(F.slice("z", 1, 1), F.transform(F.slice(F.col("z"), F.lit(2), F.size("z")), lambda x, i: F.coalesce(F.get("fixed", i), F.trim(x)))), "\n").alias("out"))
)
# Dates
query("dt01_daily_block", "SELECT event_id, date_trunc('day', ts) + INTERVAL 1 DAY AS blocked_until, ts + INTERVAL 60 SECOND AS cooldown_until, CAST(ts AS DATE) < DATE '2024-06-01' AS needs_reset FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("interval 1 day")).alias("blocked_until"), (F.col("ts") + F.expr("interval 60 seconds")).alias("cooldown_until"), (F.to_date("ts") < F.lit("2024-06-01").cast("date")).alias("needs_reset"))
)
query("dt02_ttl_expiry", "SELECT event_id, ts + to_seconds(CAST(floor(value) AS BIGINT)) - INTERVAL 5 MINUTE < TIMESTAMP '2024-06-01' AS expired FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", (F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts").cast("timestamp")) - F.expr("interval 5 minutes") < F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("expired"))
)
query("dt03_duration", "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS hms FROM (SELECT event_id, CAST(floor(value * 97) AS BIGINT) AS s FROM events)")(lambda s, d: table(s, d, "events").select("event_id", X.duration(F.col("value") * 97).alias("hms")))
# Small operators
query("ms02_representative", "SELECT event_type, first(user_id ORDER BY value, user_id) AS key FROM events WHERE value > 10 GROUP BY 1")(lambda s, d: table(s, d, "events").where("value > 10").groupBy("event_type").agg(F.min_by("user_id", F.struct("value", "user_id")).alias("key")))
query("ms03_tier_counts", "SELECT count(*) FILTER (c_acctbal < 0) AS free, count(*) FILTER (c_acctbal BETWEEN 0 AND 5000) AS paid, count(*) FILTER (c_acctbal > 5000) AS large FROM customer")(lambda s, d: table(s, d, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("free"), F.count_if(F.col("c_acctbal").between(0, 5000)).alias("paid"), F.count_if(F.col("c_acctbal") > 5000).alias("large")))
query("ms04_valid_first", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END, c_custkey) AS place FROM customer")(
    lambda s, d: group_row_number(table(s, d, "customer").select("c_mktsegment", "c_custkey", F.when(F.col("c_acctbal") > 0, 0).otherwise(1).alias("late")), "c_mktsegment", ["late", "c_custkey"], "place").select("c_mktsegment", "c_custkey", "place")
)
query("ms05_request_ratios", "SELECT r_regionkey, coalesce(sum(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END) / nullif(count(n_nationkey), 0), 1.0) AS rate FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")(
    lambda s, d: table(s, d, "region").join(table(s, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_regionkey").agg(F.coalesce(F.sum(F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(0)) / F.nullif(F.count("n_nationkey"), F.lit(0)), F.lit(1.0)).alias("rate"))
)
query("ms06_batch_summary", "SELECT event_id // 100 AS batch, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")(lambda s, d: table(s, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("batch")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed")))
query("ms07_suspicious_neighbours", "SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN length(text) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hit FROM conversations) WHERE hit = 1")(
    lambda s, d: table(s, d, "conversations").withColumn("hit", F.max((F.length("text") < 60).cast("int")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1))).where("hit = 1").select("conv_id", "turn")
)
query("ms08_marker_probe", "SELECT source, bool_or(contains(text, 'License')) AS found FROM documents GROUP BY source")(lambda s, d: table(s, d, "documents").groupBy("source").agg(F.bool_or(F.col("text").contains("License")).alias("found")))
query("ms09_retry_merge", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN upper(d.lang) END, d.lang) AS out, coalesce(CASE WHEN l.quality = 1 THEN upper(d.lang) END, d.lang) = d.lang AS still_failed FROM documents d LEFT JOIN labels l USING (doc_id)")(
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").withColumn("out", F.coalesce(F.when(F.col("quality") == 1, F.upper("lang")), F.col("lang"))).select("doc_id", "out", (F.col("out") == F.col("lang")).alias("still_failed"))
)
query("ms10_han_lines", f"WITH {INJ} SELECT doc_id, no, array_to_string(regexp_extract_all(line, '[\\x{{4e00}}-\\x{{9fff}}]+'), ', ') AS hits FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS no FROM inj) WHERE regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]')")(
    lambda s, d: injected(s, d).select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("no", "line")).withColumn("h", F.regexp_extract_all("line", F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))).where("size(h) > 0").select("doc_id", (F.col("no") + 1).cast("long").alias("no"), F.array_join("h", ", ").alias("hits"))
)
query("ms11_cleanup_report", "SELECT source, count(*) AS processed, count(*) FILTER (contains(text, '|')) AS remaining, CASE WHEN count(*) FILTER (contains(text, '|')) = 0 THEN 'complete' ELSE 'partial' END AS status FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("processed"), F.count_if(F.col("text").contains("|")).alias("remaining")).withColumn("status", F.when(F.col("remaining") == 0, "complete").otherwise("partial"))
)
query("ms12_frequency_label", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'High' WHEN p_size >= 20 THEN 'Medium' ELSE 'Low' END AS label FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_size") >= 40, "High").when(F.col("p_size") >= 20, "Medium").otherwise("Low").alias("label")))
query("ms13_naive_csv", "SELECT p_partkey, split_part(line, ',', 1) AS type, split_part(line, ',', 2) AS term FROM (SELECT p_partkey, p_type || ',' || p_name || ',' || p_size AS line FROM part) WHERE len(string_split(line, ',')) >= 2")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.split(F.concat_ws(",", "p_type", "p_name", F.col("p_size").cast("string")), ",").alias("z")).where("size(z) >= 2").withColumn("m", F.map_from_arrays(F.array(F.lit("type"), F.lit("term")), F.slice("z", 1, 2))).select("p_partkey", F.col("m")["type"].alias("type"), F.col("m")["term"].alias("term"))
)
query("ms14_character_patterns", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS patterns FROM nation GROUP BY 1")(lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("patterns")))
query("ms15_style_summary", "SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS tone, array_to_string(list_filter(string_split(text, ' '), lambda x: length(x) > 3)[1:5], ', ') AS vocabulary FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.length("text") > 150, F.concat(F.substring("text", 1, 150), F.lit("..."))).otherwise(F.col("text")).alias("tone"), F.array_join(F.slice(F.filter(F.split("text", " "), lambda x: F.length(x) > 3), 1, 5), ", ").alias("vocabulary"))
)
query("ms16_response_text", "SELECT event_id, coalesce(json_extract_string(props, '$.text'), json_extract_string(props, '$.k'), event_type) AS out FROM events")(lambda s, d: table(s, d, "events").withColumn("v", F.try_parse_json("props")).select("event_id", F.coalesce(F.try_variant_get("v", "$.text", "string"), F.try_variant_get("v", "$.k", "string"), F.col("event_type")).alias("out")))
query("ms17_short_error", f"SELECT event_id, CASE WHEN length(m) > 20 THEN substr(m, 1, 20) || '...' ELSE m END AS out FROM {MESSAGE_SQL}")(lambda s, d: messages(s, d).select("event_id", F.when(F.length("m") > 20, F.concat(F.substring("m", 1, 20), F.lit("..."))).otherwise(F.col("m")).alias("out")))
query("ms18_paragraph_mismatch", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, len(string_split(text, {NL})) AS a, lag(len(string_split(text, {NL}))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL AND abs(a - b) / b > 0.2")(
    lambda s, d: table(s, d, "conversations").withColumn("a", F.size(X.lines(F.col("text")))).withColumn("b", F.lag("a").over(W.partitionBy("conv_id").orderBy("turn"))).where("b is not null and abs(a - b) / b > 0.2").select("conv_id", "turn")
)
query("ms19_prompt_guard", "SELECT doc_id, CASE WHEN length(text) / 4 <= 500 THEN 'ok' WHEN length(text) / 4 > 900 THEN 'drop_context' ELSE 'shrink' END AS action FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.length("text") / 4 <= 500, "ok").when(F.length("text") / 4 > 900, "drop_context").otherwise("shrink").alias("action")))
query("ms20_relation_text", "SELECT n_regionkey, string_agg(n_name || ':' || n_nationkey, chr(10) ORDER BY n_name) AS out FROM nation GROUP BY 1")(lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda x: F.concat(x["n_name"], F.lit(":"), x["n_nationkey"].cast("string"))), "\n").alias("out")))
query("ms21_language_score", "SELECT user_id, first(event_type ORDER BY score DESC, event_type) AS best FROM (SELECT user_id, event_type, avg(value) * 0.6 * CASE WHEN avg(value) < 30 THEN 0.4 ELSE 1 END + count(*) * 0.4 * CASE WHEN count(*) < 10 THEN 0.5 ELSE 1 END AS score FROM events GROUP BY 1, 2) GROUP BY user_id")(
    lambda s, d: table(s, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") * 0.6 * F.when(F.avg("value") < 30, 0.4).otherwise(1.0) + F.count("*") * 0.4 * F.when(F.count("*") < 10, 0.5).otherwise(1.0)).alias("score")).groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("score"), F.col("event_type"))).alias("best"))
)
query("ms22_language_vote", "WITH v AS (SELECT source, lang, avg(n_chars) AS mean, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, count(*) AS total FROM documents GROUP BY 1) SELECT t.source, coalesce((SELECT first(lang ORDER BY mean + 15 * n / total DESC, lang) FROM v WHERE v.source = t.source AND n / total >= 0.1 AND mean >= 25), 'vie') AS lang FROM t")(
    lambda s, d: table(s, d, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("source"))).groupBy("source").agg(F.coalesce(F.min_by(F.when((F.col("share") >= 0.1) & (F.col("mean") >= 25), F.col("lang")), F.when((F.col("share") >= 0.1) & (F.col("mean") >= 25), F.struct(-(F.col("mean") + 15 * F.col("share")), F.col("lang")))), F.lit("vie")).alias("lang"))
)
query("ms23_page_batches", "SELECT o_orderkey, unnest(range(1, o_orderkey % 40 + 1, 10)) AS first_page, least(unnest(range(1, o_orderkey % 40 + 1, 10)) + 9, o_orderkey % 40) AS last_page FROM orders WHERE o_orderkey % 40 > 0")(
    lambda s, d: table(s, d, "orders").withColumn("n", F.col("o_orderkey") % 40).where("n > 0").select("o_orderkey", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(10).cast("long"))).alias("first_page")).select("o_orderkey", "first_page", F.least(F.col("first_page") + 9, F.col("n")).alias("last_page"))
)
query("ms24_natural_sort", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(regexp_replace(s_name, '\\D', '', 'g') AS BIGINT), s_name) AS place FROM supplier")(lambda s, d: table(s, d, "supplier").select("s_suppkey", F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.regexp_replace("s_name", r"\D", "").cast("long"), "s_name")).cast("long").alias("place")))
query("ms25_resume_probe", "SELECT source, bool_or(doc_id % 7 = 0) AS any_exists FROM documents GROUP BY 1")(lambda s, d: table(s, d, "documents").groupBy("source").agg(F.bool_or(F.col("doc_id") % 7 == 0).alias("any_exists")))
query("ms27_image_magic", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'invalid' END AS kind FROM pages")(
    lambda s, d: table(s, d, "pages").withColumn("head", F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("FFD8FFE0"))).when(F.col("page_id") % 3 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("3C68746D6C")))).withColumn("hex", F.hex("head")).select("page_id", F.when(F.col("hex").startswith("FFD8FF"), "jpeg").when(F.col("hex").startswith("89504E470D0A1A0A"), "png").otherwise("invalid").alias("kind"))
)
