"""Queries of HTML layout, sinks, sources that are rules, stateful folds and windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import layout as L
from foliant.functions import text as X
from foliant.operators.chunking import fold_documents
from foliant.plans.inject import INJ, injected
from foliant.plans.q_text import NL, SPLIT
from foliant.operators.windows import framed
from foliant.registry import query, table
from foliant.sources.sinks import escape_html, html_master, html_paragraph, latest
from foliant.streaming.state import CircuitBreaker, KeyHealth, PeriodicFlush, TokenBucket, carry, ordered_fold
from foliant.streaming.streams import sessions, windowed


def pages(s, d):
    return table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


query("ht01_text_map")(lambda s, d: fold_documents(pages(s, d), lambda t: [(e.text_id, e.order, e.text, e.image_only) for e in L.text_map(t, "c")[0]], "text_id string, ord int, out string, image_only boolean"))


def _upper(t):
    entries, marked = L.text_map(t, "c")
    leaf = {e.text_id: e.text.upper() for e in entries if "<p" not in e.inner and "<div" not in e.inner}
    return [(len(entries), L.reinject(marked, leaf))]


query("ht02_reinject")(lambda s, d: fold_documents(pages(s, d), _upper, "n int, out string"))
query("ht03_text_map_blocks")(lambda s, d: fold_documents(pages(s, d), lambda t: [(e.text_id, "image_ref" if e.image_only else "paragraph", e.text) for e in L.text_map(t, "c")[0]], "id string, type string, out string"))
query("src03_chapter_paragraphs")(lambda s, d: fold_documents(pages(s, d), lambda t: [("\n\n".join(L.epub_paragraphs(t)),)], "out string"))
ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
query("snk09_html_items", f"WITH {INJ} SELECT doc_id, '<p>' || replace(replace({ESCAPED}, {NL} || {NL}, '</p><p>'), {NL}, '<br>') || '</p>' AS out FROM inj")(lambda s, d: injected(s, d).select("doc_id", html_paragraph(F.col("text")).alias("out")))
query("snk03_latest_result", "SELECT user_id, arg_max(event_id, CASE WHEN event_type <> 'error' THEN 1000000000000 ELSE 0 END + event_id) AS event_id FROM events GROUP BY user_id")(
    lambda s, d: latest(table(s, d, "events").withColumn("status", F.when(F.col("event_type") != "error", "success").otherwise("partial")), "user_id", "event_id").select("user_id", "event_id")
)
query("snk10_html_master", "SELECT conv_id, '<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>' || conv_id || '</title></head><body><main id=\"nt-content\">' || string_agg('<section><p>' || turn || '</p><img src=\"a.png\"></section>', '' ORDER BY turn) || '</main></body></html>' AS html FROM conversations GROUP BY conv_id")(
    lambda s, d: html_master(table(s, d, "conversations").withColumn("body", F.concat(F.lit("<p>"), F.col("turn").cast("string"), F.lit('</p><img src="x/y/a.png">'))), "conv_id", "turn", "body", F.col("conv_id").cast("string"))
)
TITLED = f"list_transform(range(1, len({SPLIT}) + 1), lambda i: CASE WHEN i % 4 = 1 THEN '[H1]' || {SPLIT}[i] ELSE {SPLIT}[i] END)"


@query("snk11_flat_text_sections", f"""WITH l AS (SELECT doc_id, unnest({SPLIT}) AS line, generate_subscripts({SPLIT}, 1) AS no FROM documents) SELECT doc_id, CAST((no - 1) // 4 AS BIGINT) AS section, '<section><h1 data-role="chapter-title">' || first(replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') ORDER BY no) || '</h1></section>' AS html FROM l GROUP BY 1, 2""")
def flat_text_sections(s, d):
    """A section for each line with an [H1] tag."""
    rows = table(s, d, "documents").select("doc_id", F.posexplode(F.transform(X.lines(F.col("text")), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("[H1]"), x)).otherwise(x))).alias("no", "line"))
    rows = rows.withColumn("section", F.sum(F.col("line").startswith("[H1]").cast("long")).over(W.partitionBy("doc_id").orderBy("no")) - 1)
    first = rows.groupBy("doc_id", "section").agg(F.min_by("line", "no").alias("title"))
    return first.select("doc_id", "section", F.concat(F.lit('<section><h1 data-role="chapter-title">'), escape_html(F.regexp_replace("title", r"^\[H1\]", "")), F.lit("</h1></section>")).alias("html"))


query("snk15_checkpoint_ring", "SELECT user_id, list(event_id ORDER BY event_id)[-10:] AS ring FROM events GROUP BY user_id")(
    lambda s, d: table(s, d, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))).where("k <= 10").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ring"))
)
query("src19_table_rows", "SELECT p_partkey, CASE WHEN contains(p_name, ' | ') THEN '\"' || replace(p_name, '\"', '\"\"') || '\"' ELSE p_name END || ' | ' || p_brand || ' | ' AS line FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN p_name || ' | x' ELSE p_name END AS p_name, p_brand FROM part)")(lambda s, d: table_rows(s, d))


def table_rows(s, d):
    """Cells padded to three columns, quoted where they hold the delimiter."""
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit(" | x"))).otherwise(F.col("p_name"))
    cells = F.slice(F.concat(F.array(name, F.col("p_brand")), F.array_repeat(F.lit(""), 3)), 1, 3)
    quoted = F.transform(cells, lambda c: F.when(c.contains(" | "), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return table(s, d, "part").select("p_partkey", F.array_join(quoted, " | ").alias("line"))


query("src20_foreign_chunks", f"WITH {INJ} SELECT doc_id, array_to_string(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{0e00}}-\\x{{0e7f}}\\x{{ac00}}-\\x{{d7af}}\\x{{3040}}-\\x{{30ff}}]+'), ',') AS found FROM inj WHERE regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]')")(
    lambda s, d: injected(s, d).where(F.col("text").rlike(r"[\x{4e00}-\x{9fff}]")).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"[\x{4e00}-\x{9fff}\x{0e00}-\x{0e7f}\x{ac00}-\x{d7af}\x{3040}-\x{30ff}]+"), F.lit(0)), ",").alias("found"))
)
ALIAS = {"Term": ("Original_Term_CN", "p_name"), "Kind": ("p_type",), "Extra": ("none",)}
query("prj01_alias_columns", "SELECT p_partkey, p_name AS Term, p_type AS Kind, '' AS Extra FROM part")(
    lambda s, d: (lambda p: p.select("p_partkey", *[(F.col(next(a for a in names if a in p.columns)) if any(a in p.columns for a in names) else F.lit("")).alias(k) for k, names in ALIAS.items()]))(table(s, d, "part"))
)
query("prj03_key_coalesce", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, ''), nullif(p_name, ''), '') AS key FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.coalesce(F.nullif(F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand")), F.lit("")), F.nullif("p_name", F.lit("")), F.lit("")).alias("key"))
)


def timed(s, d):
    return table(s, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_type")


def _bucket(b, row):
    return row["event_id"], b.consume(row["at"])


def _breaker(b, row):
    allowed = b.allows(row["at"])
    if allowed:
        b.record(row["event_type"] != "error", row["at"])
    return row["event_id"], allowed, b.state


def _health(k, row):
    free = k.available(row["at"])
    k.record({"error": "other", "purchase": "rate_limit", "click": "success"}.get(row["event_type"], "success"), row["at"])
    return row["event_id"], free, k.active, k.errors


def _carry(buffer, row):
    return row["conv_id"], row["turn"], ",".join(carry(buffer, [w for w in ("the", "der", "License") if w in row["text"]]))


#: Events of each user in order, numbered, for the folds as recursions.
ORDERED = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
NEXT = "r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1"


def fold_sql(state: str, first: str, step: str, out: str) -> str:
    """A fold per user as a recursion: columns of the state, their values at the first row and at each next one, and what a row gives."""
    names = state.split(", ")
    return f"WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, k, event_id, {first} FROM e WHERE k = 1 UNION ALL SELECT user_id, k, event_id, {', '.join(names)} FROM ({step})) SELECT event_id, {out} FROM r"


query("st01_token_bucket", fold_sql("allowed, tokens, tm", "TRUE AS allowed, 1.0::DOUBLE AS tokens, tm",
    f"SELECT user_id, k, event_id, have >= 1 AS allowed, CASE WHEN have >= 1 THEN have - 1 ELSE have END AS tokens, now AS tm FROM (SELECT e.user_id, e.k, e.event_id, e.tm AS now, CASE WHEN e.tm > r.tm THEN least(2.0::DOUBLE, r.tokens + (e.tm - r.tm) * (1.0::DOUBLE / 3600.0::DOUBLE)) ELSE r.tokens END AS have FROM {NEXT})", "allowed"))(
    lambda s, d: ordered_fold(timed(s, d), "user_id", ["at", "event_id"], lambda: TokenBucket(1 / 3600, 2), _bucket, "event_id bigint, allowed boolean")
)
query("st04_circuit_breaker", fold_sql("allowed, state, changed, failures, successes", "TRUE AS allowed, 'CLOSED' AS state, 0.0::DOUBLE AS changed, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failures, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS successes",
    f"""SELECT user_id, k, event_id, allowed, CASE WHEN NOT allowed THEN s WHEN ok AND s = 'HALF_OPEN' AND n + 1 >= 3 THEN 'CLOSED' WHEN NOT ok AND (s = 'HALF_OPEN' OR f + 1 >= 2) THEN 'OPEN' ELSE s END AS state,
      CASE WHEN allowed AND (ok AND s = 'HALF_OPEN' AND n + 1 >= 3 OR NOT ok AND (s = 'HALF_OPEN' OR f + 1 >= 2)) THEN now ELSE c END AS changed,
      CASE WHEN NOT allowed THEN f WHEN NOT ok THEN f + 1 WHEN s = 'CLOSED' OR n + 1 >= 3 THEN 0 ELSE f END AS failures, CASE WHEN allowed AND ok THEN n + 1 ELSE n END AS successes
    FROM (SELECT *, s <> 'OPEN' AS allowed FROM (SELECT e.user_id, e.k, e.event_id, e.tm AS now, e.event_type <> 'error' AS ok, successes AS n, CASE WHEN half THEN 'HALF_OPEN' ELSE state END AS s, CASE WHEN half THEN e.tm ELSE changed END AS c, CASE WHEN half THEN 0 ELSE failures END AS f
      FROM (SELECT r.*, e.tm AS now, state = 'OPEN' AND e.tm - changed >= 3600 AS half FROM {NEXT}) r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))""", "allowed, state"))(
    lambda s, d: ordered_fold(timed(s, d), "user_id", ["at", "event_id"], lambda: CircuitBreaker(2, 3600), _breaker, "event_id bigint, allowed boolean, state string")
)
KIND = "CASE event_type WHEN 'error' THEN 'other' WHEN 'purchase' THEN 'limit' ELSE 'success' END"
query("st05_key_health", fold_sql("available, active, errors, used, blocked", f"TRUE AS available, TRUE AS active, CASE WHEN {KIND} = 'other' THEN 1 ELSE 0 END AS errors, CASE WHEN {KIND} = 'success' THEN 1 ELSE 0 END AS used, CASE WHEN {KIND} = 'limit' THEN tm + 60 ELSE 0.0::DOUBLE END AS blocked",
    f"""SELECT e.user_id, e.k, e.event_id, active AND e.tm >= blocked AND used < 20 AS available, active AND NOT ({KIND} = 'other' AND errors + 1 >= 10) AS active, CASE {KIND} WHEN 'other' THEN errors + 1 WHEN 'success' THEN 0 ELSE errors END AS errors,
      used + CASE WHEN {KIND} = 'success' THEN 1 ELSE 0 END AS used, CASE WHEN {KIND} = 'limit' THEN greatest(blocked, e.tm + 60) ELSE blocked END AS blocked FROM {NEXT}""", "available, active, CAST(errors AS BIGINT) AS errors"))(
    lambda s, d: ordered_fold(timed(s, d), "user_id", ["at", "event_id"], KeyHealth, _health, "event_id bigint, available boolean, active boolean, errors bigint")
)
WORDS = "list_filter(['the', 'der', 'License'], lambda w: contains(text, w))"
query("st06_carry_buffer", f"""WITH RECURSIVE c AS (SELECT conv_id, turn, {WORDS} AS found, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    r AS (SELECT conv_id, turn, k, found AS names, found AS buffer FROM c WHERE k = 1 UNION ALL
      SELECT c.conv_id, c.turn, c.k, CASE WHEN len(found) > 0 THEN found ELSE buffer END, list_concat(buffer, list_filter(found, lambda w: NOT list_contains(buffer, w))) FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1)
    SELECT conv_id, turn, array_to_string(names, ',') AS names FROM r""")(
    lambda s, d: ordered_fold(table(s, d, "conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], list, _carry, "conv_id bigint, turn bigint, names string")
)
query("st07_periodic_flush", fold_sql("flushed, held, last", "CAST(0 AS BIGINT) AS flushed, 1 AS held, tm AS last",
    f"SELECT user_id, k, event_id, CASE WHEN due THEN held ELSE 0 END AS flushed, CASE WHEN due THEN 0 ELSE held END AS held, CASE WHEN due THEN now ELSE last END AS last FROM (SELECT e.user_id, e.k, e.event_id, e.tm AS now, r.held + 1 AS held, last, r.held + 1 >= 3 OR e.tm - last >= 7200 AS due FROM {NEXT})", "CAST(flushed AS BIGINT) AS flushed"))(
    lambda s, d: ordered_fold(timed(s, d), "user_id", ["at", "event_id"], lambda: PeriodicFlush(3, 7200), lambda b, row: (row["event_id"], b.add(row["at"])), "event_id bigint, flushed bigint")
)
query("st08_resume", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = 1)")(lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels").where("quality = 1"), "doc_id", "left_anti"))
query("st10_adaptive_workers", "SELECT event_id, CASE WHEN m > 120 THEN greatest(1, CAST(floor(8 * 0.75) AS INTEGER)) WHEN m < 40 THEN CAST(ceil(8 * 1.25) AS INTEGER) ELSE 8 END AS workers FROM (SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) AS m FROM events)")(
    lambda s, d: framed(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], 9, lambda w: {"m": F.avg("value").over(w)}).select("event_id", F.when(F.col("m") > 120, 6).when(F.col("m") < 40, 10).otherwise(8).alias("workers"))
)
query("st11_backoff", "SELECT event_id, CAST(5 * pow(2, least(2, event_id % 3)) AS INTEGER) AS seconds FROM events WHERE event_type = 'error'")(lambda s, d: table(s, d, "events").where("event_type = 'error'").select("event_id", (5 * F.pow(F.lit(2), F.least(F.lit(2), F.col("event_id") % 3))).cast("int").alias("seconds")))
# Additions: event-time windows, run here in batch; tests run them as streams.
query("ext_tumbling_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")(
    lambda s, d: windowed(table(s, d, "events"), "6 hours")
)
query("ext_session_window", "SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, TRUE) AS fresh FROM events)) GROUP BY user_id, k")(
    lambda s, d: sessions(table(s, d, "events"), "30 minutes")
)
