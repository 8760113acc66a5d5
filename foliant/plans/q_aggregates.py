"""Queries of the aggregations: run, key and size statistics, merges and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators.windows import framed, group_row_number, top_per_key
from foliant.registry import query, table


def events(s, d):
    return table(s, d, "events")


def fail():
    return F.col("event_type") == "error"


query("ag01_run_statistics", "SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate, avg(value) AS avg_duration, min(value) AS min_duration, max(value) AS max_duration FROM events")(
    lambda s, d: events(s, d).agg(F.count("*").alias("n"), F.count_if(~fail()).alias("success"), F.count_if(fail()).alias("failed"), (F.count_if(~fail()) / F.count("*")).alias("success_rate"), F.avg("value").alias("avg_duration"), F.min("value").alias("min_duration"), F.max("value").alias("max_duration"))
)
query("ag02_counts_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: events(s, d).groupBy("event_type").agg(F.count("*").alias("n")))
query("ag03_per_key", "SELECT user_id, count(*) AS requests, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate, avg(value) AS avg_duration FROM events GROUP BY user_id")(
    lambda s, d: events(s, d).groupBy("user_id").agg(F.count("*").alias("requests"), (F.count_if(~fail()) / F.count("*")).alias("success_rate"), F.avg("value").alias("avg_duration"))
)
query("ag04_cache_hit_percent", "SELECT source, CASE WHEN sum(n_chars) > 0 THEN round(100.0 * sum(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 0 END) / sum(n_chars), 2) ELSE 0 END AS pct FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.coalesce(F.round(F.lit(100.0) * F.sum(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(0)) / F.nullif(F.sum("n_chars"), F.lit(0)), 2), F.lit(0.0)).alias("pct"))
)
query("ag05_flush_statistics", "SELECT event_type, count(*) AS flush_count, sum(value) AS total, coalesce(avg(value), 0) AS avg_duration, max(ts) AS last_flush FROM events GROUP BY event_type")(
    lambda s, d: events(s, d).groupBy("event_type").agg(F.count("*").alias("flush_count"), F.sum("value").alias("total"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg_duration"), F.max("ts").alias("last_flush"))
)
query("ag06_bounded_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5")(lambda s, d: top_per_key(events(s, d), ["user_id"], [F.desc("event_id")], 5).select("user_id", "event_id"))
query("ag07_size_statistics", "SELECT source, avg(n_chars) AS mean, median(n_chars) AS median, stddev_samp(n_chars) AS stdev, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean"), F.median("n_chars").alias("median"), F.stddev_samp("n_chars").alias("stdev"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
)


def with_stats(s, d, **more):
    """Documents with the mean, deviation and count of their source: one small table joined back, no window over a whole source."""
    docs = table(s, d, "documents").select("doc_id", "source", "n_chars")
    return docs.join(docs.groupBy("source").agg(F.avg("n_chars").alias("m"), F.stddev_samp("n_chars").alias("sd"), F.count("*").alias("n")), "source")


query("ag08_deviation", "SELECT doc_id, abs(m - n_chars) / m AS deviation, n_chars / m < 0.8 AS too_small FROM documents JOIN (SELECT source, avg(n_chars) AS m FROM documents GROUP BY source) USING (source)")(lambda s, d: with_stats(s, d).select("doc_id", (F.abs(F.col("m") - F.col("n_chars")) / F.col("m")).alias("deviation"), (F.col("n_chars") / F.col("m") < 0.8).alias("too_small")))
query("ag09_z_score", "SELECT doc_id FROM documents JOIN (SELECT source, avg(n_chars) AS m, stddev_samp(n_chars) AS sd FROM documents GROUP BY source) USING (source) WHERE n_chars < m AND (m - n_chars) / sd > 0.6")(lambda s, d: with_stats(s, d).where("n_chars < m and (m - n_chars) / sd > 0.6").select("doc_id"))


@query("ag10_percentile_rank", "WITH t AS (SELECT source, list(n_chars ORDER BY n_chars) AS z FROM documents GROUP BY source HAVING count(*) >= 10) SELECT doc_id FROM documents JOIN t USING (source) WHERE n_chars < z[CAST(floor(len(z) * 0.15) AS BIGINT) + 1]")
def percentile_rank(s, d):
    """Rows below their group's nearest-rank percentile; the rank is found by numbering rows, not by collecting them."""
    docs = table(s, d, "documents").select("doc_id", "source", "n_chars")
    ranked = group_row_number(docs, "source", ["n_chars", "doc_id"])
    cut = ranked.where("n >= 10 and k = floor(n * 0.15) + 1").select("source", F.col("n_chars").alias("cut"))
    return docs.join(cut, "source").where("n_chars < cut").select("doc_id")


query("ag11_progress_statistics", "SELECT lang, count(*) AS n, avg(quality) AS mean_quality, coalesce(sum(toxic), 0) AS retries FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")(
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("mean_quality"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("retries"))
)
query("ag12_glossary_merge", "SELECT p_brand AS term, arg_max(p_partkey, p_size * 1e12 + length(p_name) * 1e8 - p_partkey) AS kept, max(p_size) AS frequency FROM part GROUP BY p_brand")(
    lambda s, d: top_per_key(table(s, d, "part"), ["p_brand"], [F.desc("p_size"), F.length("p_name").desc(), F.col("p_partkey")]).select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("kept"), F.col("p_size").alias("frequency"))
)
query("ag13_relation_merge", "SELECT p_type, p_brand, min(p_partkey) AS kept FROM part GROUP BY 1, 2")(lambda s, d: top_per_key(table(s, d, "part"), ["p_type", "p_brand"], [F.col("p_partkey")]).select("p_type", "p_brand", F.col("p_partkey").alias("kept")))
query("ag14_format_consistency", "WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, max(n) / sum(n) AS consistency, arg_min(p_brand, (-n, p_brand)) AS common FROM c GROUP BY p_type".replace("arg_min(p_brand, (-n, p_brand))", "first(p_brand ORDER BY n DESC, p_brand)"))(
    lambda s, d: table(s, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n")).groupBy("p_type").agg((F.max("n") / F.sum("n")).alias("consistency"), F.min_by("p_brand", F.struct(-F.col("n"), F.col("p_brand"))).alias("common"))
)
query("ag15_distinct_profile", "SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, count(*) AS n FROM part")(lambda s, d: table(s, d, "part").agg(F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_type").alias("types"), F.countDistinct("p_size").alias("sizes"), F.count("*").alias("n")))
query("ag16_compare_systems", "SELECT 'part' AS system, count(*) AS n, avg(p_retailprice) AS mean FROM part UNION ALL SELECT 'customer', count(*), avg(c_acctbal) FROM customer")(
    lambda s, d: table(s, d, "part").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean")).select(F.lit("part").alias("system"), "n", "mean").unionByName(table(s, d, "customer").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")).select(F.lit("customer").alias("system"), "n", "mean"))
)
query("ag17_ab_statistics", "SELECT user_id % 2 AS variant, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most, count(*) FILTER (event_type = 'error') / count(*) AS error_rate FROM events GROUP BY 1")(
    lambda s, d: events(s, d).groupBy((F.col("user_id") % 2).alias("variant")).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), (F.count_if(fail()) / F.count("*")).alias("error_rate"))
)
query("ag18_stage_profile", "SELECT lang, avg(floor(length(text) / 4.0)) AS avg_tokens, avg(floor(length(text) / 4.0)) / 10000 AS utilization FROM documents GROUP BY lang")(lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.avg(F.floor(F.length("text") / 4.0)).alias("avg_tokens")).withColumn("utilization", F.col("avg_tokens") / 10000))
query("ag19_completion_report", "SELECT source, count(*) AS total, count(quality) AS done, count(*) - count(quality) AS missing, round(100.0 * count(quality) / count(*), 1) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")(
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("done"), (F.count("*") - F.count("quality")).alias("missing"), F.round(F.lit(100.0) * F.count("quality") / F.count("*"), 1).alias("pct"))
)
query("ag20_error_metrics", "SELECT user_id, count(*) AS errors, count(*) FILTER (value > 50) / greatest(1, count(*)) AS recovery_rate FROM events WHERE event_type = 'error' GROUP BY user_id")(lambda s, d: events(s, d).where(fail()).groupBy("user_id").agg(F.count("*").alias("errors"), (F.count_if(F.col("value") > 50) / F.greatest(F.lit(1), F.count("*"))).alias("recovery_rate")))
query("ag21_key_pool", "SELECT c_mktsegment, count(*) FILTER (c_acctbal > 0) AS active, sum(c_acctbal) AS used, count(*) FILTER (c_acctbal <= 0) / count(*) AS blocked_ratio, min(least(nullif(c_custkey % 7, 0), nullif(c_custkey % 11, 0))) AS earliest FROM customer GROUP BY 1")(
    lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 0).alias("active"), F.sum("c_acctbal").alias("used"), (F.count_if(F.col("c_acctbal") <= 0) / F.count("*")).alias("blocked_ratio"), F.min(F.least(F.nullif(F.col("c_custkey") % 7, F.lit(0)), F.nullif(F.col("c_custkey") % 11, F.lit(0)))).alias("earliest"))
)
query("ag22_response_buckets", "SELECT event_id, CASE WHEN value < m * 0.8 THEN 'response_fast' WHEN value < m * 1.2 THEN 'response_normal' ELSE 'response_slow' END AS bucket FROM events, (SELECT avg(value) AS m FROM events WHERE event_type <> 'error') WHERE event_type <> 'error'")(
    lambda s, d: (lambda e: e.join(F.broadcast(e.agg(F.avg("value").alias("m")))).select("event_id", F.when(F.col("value") < F.col("m") * 0.8, "response_fast").when(F.col("value") < F.col("m") * 1.2, "response_normal").otherwise("response_slow").alias("bucket")))(events(s, d).where(~fail()))
)
CLASS_SQL = "CASE WHEN contains(lower(m), 'billing') OR contains(lower(m), 'payment') THEN 'error_billing' WHEN contains(lower(m), 'access denied') OR contains(lower(m), 'permission') THEN 'error_permission' WHEN contains(lower(m), 'invalid') THEN 'error_invalid' WHEN contains(lower(m), 'quota') OR contains(lower(m), '429') THEN 'error_quota' ELSE 'error_unknown' END"
MESSAGES = ("429 Resource exhausted: quota", "Billing account required", "Permission denied for model", "invalid api key", "503 internal server error", "rate limit exceeded, retry after: 12.5s", "timeout while reading", "blocked by safety settings", "500 Internal", "API key not valid 401")
MESSAGE_SQL = "(SELECT event_id, user_id, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MESSAGES)) + " END AS m FROM events)"


def messages(s, d):
    pick = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 10 + 1).cast("int"))
    return events(s, d).select("event_id", "user_id", pick.alias("m"))


def error_group(m):
    low = F.lower(m)
    has = lambda *w: F.exists(F.array(*map(F.lit, w)), lambda x: low.contains(x))
    return F.when(has("billing", "payment"), "error_billing").when(has("access denied", "permission"), "error_permission").when(has("invalid"), "error_invalid").when(has("quota", "429"), "error_quota").otherwise("error_unknown")


query("ag23_error_groups", f"SELECT {CLASS_SQL} AS kind, count(*) AS n, count(DISTINCT user_id) AS keys FROM {MESSAGE_SQL} GROUP BY 1")(lambda s, d: messages(s, d).groupBy(error_group(F.col("m")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("keys")))
query("ag24_rolling_mean", "SELECT event_id, CASE WHEN count(*) OVER w >= 3 THEN avg(value) OVER w END AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING)")(
    lambda s, d: framed(events(s, d).select("user_id", "event_id", "value"), "user_id", ["event_id"], 9, lambda w: {"n": F.count("*").over(w), "a": F.avg("value").over(w)}).select("event_id", F.when(F.col("n") >= 3, F.col("a")).alias("mean"))
)
query("ag25_majority_vote", "WITH v AS (SELECT conv_id, sum(CASE WHEN contains(lower(text), ' he ') THEN 2 WHEN contains(lower(text), 'he') THEN 1 ELSE 0 END) AS a, sum(CASE WHEN contains(lower(text), ' she ') THEN 2 WHEN contains(lower(text), 'sh') THEN 1 ELSE 0 END) AS b FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN a > b THEN 'a' WHEN b > a THEN 'b' END AS winner FROM v")(
    lambda s, d: table(s, d, "conversations").withColumn("l", F.lower("text")).groupBy("conv_id").agg(F.sum(F.when(F.col("l").contains(" he "), 2).when(F.col("l").contains("he"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("l").contains(" she "), 2).when(F.col("l").contains("sh"), 1).otherwise(0)).alias("b")).select("conv_id", F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b").alias("winner"))
)
query("ag26_timeout_statistics", "SELECT event_type, avg(value) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")(lambda s, d: events(s, d).groupBy("event_type").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")))
query("ag27_variant_vote", "SELECT user_id, CASE WHEN coalesce(avg(value) FILTER (value > 0 AND event_id % 2 = 1), 0) > coalesce(avg(value) FILTER (value > 0 AND event_id % 2 = 0), 0) + 5 THEN 'chi_tra' ELSE 'chi_sim' END AS variant FROM events GROUP BY user_id")(
    lambda s, d: events(s, d).groupBy("user_id").agg(F.coalesce(F.avg(F.when((F.col("value") > 0) & (F.col("event_id") % 2 == 1), F.col("value"))), F.lit(0.0)).alias("t"), F.coalesce(F.avg(F.when((F.col("value") > 0) & (F.col("event_id") % 2 == 0), F.col("value"))), F.lit(0.0)).alias("s")).select("user_id", F.when(F.col("t") > F.col("s") + 5, "chi_tra").otherwise("chi_sim").alias("variant"))
)
query("ag28_token_usage", "SELECT role, sum(length(text)) AS chars, sum(CAST(floor(length(text) / 4.0) AS BIGINT)) AS tokens FROM conversations GROUP BY role")(lambda s, d: table(s, d, "conversations").groupBy("role").agg(F.sum(F.length("text").cast("long")).alias("chars"), F.sum(F.floor(F.length("text") / 4.0).cast("long")).alias("tokens")))
query("ag29_distinct_terms", "SELECT DISTINCT trim(p_name) AS term FROM part WHERE trim(p_name) <> ''")(lambda s, d: table(s, d, "part").select(F.trim("p_name").alias("term")).where("term <> ''").distinct())
