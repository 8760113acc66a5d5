"""Queries of the joins that matching, lookups and recovery imply."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators.graph import linked_groups
from foliant.operators.matching import find_terms, join_terms
from foliant.operators.windows import top_per_key
from foliant.plans.inject import INJ, injected
from foliant.plans.q_text import strip
from foliant.registry import query, table

TERMS = ("the", "and", "thing", "licensed under", "der", "die", "剑法", "世界", "apache license", "license")
PLAIN = [t for t in TERMS if not any("一" <= c <= "鿿" for c in t)]
HAN_TERMS = [t for t in TERMS if t not in PLAIN]
TERM_VALUES = ", ".join(f"('{t}')" for t in PLAIN)


@query("jn01_glossary_matches", f"""WITH {INJ}, plain AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])(' || '{'|'.join(sorted(PLAIN, key=lambda t: (-len(t), t)))}' || ')', 1)) AS term, lower(text) AS low FROM inj),
    han AS (SELECT doc_id, h.term FROM inj, (VALUES {', '.join(f"('{t}')" for t in HAN_TERMS)}) h(term) WHERE contains(text, h.term) OR contains(regexp_replace(text, '\\s+', '', 'g'), h.term)),
    words AS (SELECT DISTINCT i.doc_id, t.term FROM inj i, (VALUES {TERM_VALUES}) t(term) WHERE regexp_matches(lower(i.text), '(?:^|[^\\p{{L}}\\p{{N}}_])' || t.term || '(?:[^\\p{{L}}\\p{{N}}_]|$)') AND t.term NOT IN ('license', 'apache license') UNION ALL
      SELECT DISTINCT i.doc_id, t.term FROM inj i, (VALUES ('apache license'), ('license')) t(term) WHERE CASE WHEN t.term = 'license' THEN regexp_matches(replace(lower(i.text), 'apache license', ''), '(?:^|[^\\p{{L}}\\p{{N}}_])license(?:[^\\p{{L}}\\p{{N}}_]|$)') ELSE regexp_matches(lower(i.text), '(?:^|[^\\p{{L}}\\p{{N}}_])apache license(?:[^\\p{{L}}\\p{{N}}_]|$)') END)
    SELECT doc_id, term FROM words UNION SELECT doc_id, term FROM han""")
def glossary_matches(s, d):
    """Leftmost-longest, non-overlapping matches of a small dictionary in one scan of each text."""
    return injected(s, d).select("doc_id", F.explode(find_terms(F.col("text"), list(TERMS))).alias("term"))


query("jn01_glossary_join", r"WITH t AS (SELECT DISTINCT lower(n_name) AS term FROM nation UNION SELECT * FROM (VALUES ('of the'), ('licensed under'), ('der die'))) SELECT DISTINCT doc_id, term FROM documents, t WHERE regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])' || term || '(?:[^\p{L}\p{N}_]|$)')")(
    lambda s, d: join_terms(table(s, d, "documents"), table(s, d, "nation").select(F.lower("n_name").alias("term")).unionByName(s.createDataFrame([("of the",), ("licensed under",), ("der die",)], "term string")).distinct())
)


@query("jn02_terms_to_rows", """WITH t AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, ' ', '  ') END AS term FROM part),
    exact AS (SELECT p_name AS term, min(p_partkey) AS first_row, count(*) AS n FROM part GROUP BY 1),
    folded AS (SELECT regexp_replace(lower(p_name), '\\s+', '', 'g') AS fold, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1)
    SELECT t.term, e.term IS NOT NULL AS exact, coalesce(e.first_row, g.first_row) AS first_row, coalesce(e.n, g.n) AS n FROM t LEFT JOIN exact e ON e.term = t.term
    LEFT JOIN folded f ON f.fold = regexp_replace(lower(t.term), '\\s+', '', 'g') LEFT JOIN exact g ON g.term = f.name WHERE coalesce(e.first_row, g.first_row) IS NOT NULL""")
def terms_to_rows(s, d):
    """Rows of each matched term: those of the same name, else those of the first name that is the same but for case and spaces."""
    part = table(s, d, "part").select("p_partkey", "p_name")
    found = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("  ")))
    fold = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    terms = part.select(found.alias("term")).distinct().withColumn("fold", fold(F.col("term")))
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first_row"), F.count("*").alias("n"))
    first = names.groupBy(fold(F.col("name")).alias("fold")).agg(F.min_by(F.struct("first_row", "n"), "first_row").alias("other"))
    met = terms.join(names, F.col("term") == F.col("name"), "left").join(first, "fold", "left")
    met = met.select("term", F.col("name").isNotNull().alias("exact"), F.coalesce("first_row", "other.first_row").alias("first_row"), F.coalesce("n", "other.n").alias("n"))
    return met.where("first_row is not null")


query("jn03_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left_anti"))
query("jn04_completed_content", "SELECT doc_id, coalesce(quality, -1) AS quality, l.doc_id IS NOT NULL AS found FROM documents LEFT JOIN labels l USING (doc_id)".replace("l.doc_id IS NOT NULL", "quality IS NOT NULL"))(
    lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("quality").isNotNull().alias("found"))
)
query("jn05_failed_to_original", "SELECT f.event_id, f.user_id, CAST(c.c_name AS VARCHAR) AS name, c.c_custkey IS NULL AS still_failed FROM (SELECT * FROM events WHERE event_type = 'error') f LEFT JOIN customer c ON f.user_id = c.c_custkey")(
    lambda s, d: table(s, d, "events").where("event_type = 'error'").join(table(s, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", F.col("c_name").alias("name"), F.col("c_custkey").isNull().alias("still_failed"))
)
query("jn06_missing_on_disk", "SELECT l.doc_id FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = l.doc_id)")(
    lambda s, d: table(s, d, "labels").select("doc_id").join(table(s, d, "documents"), "doc_id", "left_semi").join(table(s, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti")
)
NAMES = ("Thing", "Ofthe", "Apache", "世界", "Der")


@query("jn07_active_characters", f"WITH {INJ} SELECT doc_id, n.name FROM inj, (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in NAMES)}) n(name) WHERE CASE WHEN n.name = '世界' THEN contains(text, n.name) ELSE regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])' || n.name || '(?:$|[\\s''\",.?!:;])') END")
def active_characters(s, d):
    """Names in a text: a cheap substring test first, then the pattern with its boundaries."""
    def hit(name):
        if name == "世界":
            return F.col("text").contains(name)
        return F.lower("text").contains(name.lower()) & F.col("text").rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){name}(?=\s|['\",.?!:;]|$|'s|'S)")

    return injected(s, d).select("doc_id", F.explode(F.array_compact(F.array(*[F.when(hit(n), F.lit(n)) for n in NAMES]))).alias("name"))


query("jn08_pair_rules", "SELECT e.event_id, n.n_name AS rule FROM events e JOIN nation n ON e.user_id % 25 = n.n_nationkey AND e.event_id % 5 = n.n_regionkey")(
    lambda s, d: table(s, d, "events").select("event_id", (F.col("user_id") % 25).alias("a"), (F.col("event_id") % 5).alias("b")).join(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"), F.col("n_name").alias("rule")), ["a", "b"]).select("event_id", "rule")
)
query("jn09_character_pairs", "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")(
    lambda s, d: (lambda n: n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_name") < F.col("b.n_name"))).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second")))(table(s, d, "nation"))
)
MARKED = "(SELECT conv_id, string_agg(text || chr(10) || '[TX:t' || turn || ']' || chr(10), '' ORDER BY turn) AS translated FROM conversations GROUP BY conv_id)"


def marked(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.col("text"), F.lit("\n[TX:t"), F.col("turn").cast("string"), F.lit("]\n")).alias("part"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "").alias("translated"), F.array_sort(F.collect_list(F.concat(F.lit("t"), F.col("turn").cast("string")))).alias("ids"))


def marker_segments(text):
    """(id, segment) pairs: each segment stands before its marker; blank ones are dropped."""
    ids = F.regexp_extract_all(text, F.lit(r"\[TX:([^\]]+)\]"), F.lit(1))
    parts = F.slice(F.split(text, r"\[TX:[^\]]+\]", -1), F.lit(1), F.size(ids))
    return F.filter(F.transform(F.arrays_zip(ids.alias("id"), parts.alias("segment")), lambda x: F.struct(x["id"].alias("id"), X.strip(x["segment"]).alias("segment"))), lambda x: x["segment"] != "")


query("jn10_translation_map", f"SELECT conv_id, 't' || turn AS text_id, {strip('text')} AS segment FROM conversations WHERE {strip('text')} <> ''")(
    lambda s, d: marked(s, d).select("conv_id", "ids", F.explode(marker_segments(F.col("translated"))).alias("x")).where(F.array_contains("ids", F.col("x.id"))).select("conv_id", F.col("x.id").alias("text_id"), "x.segment")
)
query("ch09_marker_segments", f"SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE {strip('text')} <> '' GROUP BY conv_id")(lambda s, d: marked(s, d).select("conv_id", F.size(marker_segments(F.col("translated"))).cast("long").alias("n")))
LABELS = "(SELECT user_id, 'q' || CAST(count(*) FILTER (event_type = 'error') % 7 AS VARCHAR) AS g FROM events GROUP BY user_id UNION ALL SELECT user_id, 'n' || CAST(count(*) % 9 AS VARCHAR) FROM events GROUP BY user_id UNION ALL SELECT user_id, 't' || CAST(count(*) FILTER (event_type = 'click') % 6 AS VARCHAR) FROM events GROUP BY user_id)"


@query("jn12_linked_keys", f"""WITH RECURSIVE m AS (SELECT user_id, g FROM {LABELS}), c AS (SELECT a.user_id, a.g || '|' || b.g AS combo FROM m a JOIN m b ON a.user_id = b.user_id AND a.g < b.g),
    e AS (SELECT DISTINCT a.combo AS a, b.combo AS b FROM c a JOIN c b ON a.user_id = b.user_id), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    low AS (SELECT r.a AS combo, min(c.user_id) AS low FROM r JOIN c ON c.combo = r.b GROUP BY 1)
    SELECT user_id, min(low) AS account FROM c JOIN low USING (combo) GROUP BY user_id""")
def linked_keys(s, d):
    """Keys that share at least two group labels, closed under reachability."""
    e = table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("q"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("t"))
    labels = e.select("user_id", F.explode(F.array(F.concat(F.lit("q"), (F.col("q") % 7).cast("string")), F.concat(F.lit("n"), (F.col("n") % 9).cast("string")), F.concat(F.lit("t"), (F.col("t") % 6).cast("string")))).alias("label"))
    return linked_groups(labels, "user_id", "label", 2).withColumnRenamed("group_id", "account")


@query("jn13_best_sentence", """WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]?'), lambda x: trim(x)), lambda x: x <> '') AS z, (SELECT list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]) FROM (SELECT list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 6) AS w)) AS terms FROM conversations),
    c AS (SELECT conv_id, turn, terms, generate_subscripts(z, 1) - 1 AS no, unnest(z) AS sentence FROM s WHERE len(terms) > 0), k AS (SELECT conv_id, turn, no, sentence, len(list_filter(terms, lambda t: contains(lower(sentence), t))) / len(terms) AS score FROM c)
    SELECT conv_id, turn, max(score) AS score FROM k GROUP BY 1, 2 HAVING max(score) >= 0.5""")
def best_sentence(s, d):
    """The first sentence with the best share of a turn's terms, if at least half."""
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 6))
    rows = table(s, d, "conversations").withColumn("terms", terms).where("size(terms) > 0")
    rows = rows.select("conv_id", "turn", "terms", F.posexplode(F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[^.!?]*[.!?]?"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")).alias("no", "sentence"))
    rows = rows.withColumn("score", F.size(F.filter("terms", lambda t: F.lower("sentence").contains(t))) / F.size("terms"))
    return top_per_key(rows, ["conv_id", "turn"], [F.desc("score"), F.col("no")]).where("score >= 0.5").select("conv_id", "turn", "score")


STRATEGY = (("rate_limit", True, 60), ("quota_exceeded", True, 3600), ("invalid_key", False, 0))
query("jn15_recovery_strategy", "SELECT event_id, coalesce(s.retry, TRUE) AS should_retry, coalesce(s.cooldown, 60) AS cooldown FROM events LEFT JOIN (VALUES ('error', TRUE, 30), ('purchase', FALSE, 0)) s(kind, retry, cooldown) ON event_type = s.kind")(
    lambda s, d: table(s, d, "events").join(F.broadcast(s.createDataFrame([("error", True, 30), ("purchase", False, 0)], "event_type string, retry boolean, cooldown int")), "event_type", "left").select("event_id", F.coalesce("retry", F.lit(True)).alias("should_retry"), F.coalesce("cooldown", F.lit(60)).alias("cooldown"))
)
LANG = {"VN": "vie", "EN": "eng", "CN": "chi", "VIE": "vie", "ENG": "eng", "CHI": "chi", "AUTO": "auto"}
query("jn16_language_codes", "SELECT doc_id, array_to_string(list_transform(string_split(upper(trim(lang || CASE WHEN doc_id % 3 = 0 THEN '+vn' WHEN doc_id % 3 = 1 THEN ' + CN' ELSE '' END)), '+'), lambda p: CASE trim(p) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANG.items()) + " ELSE lower(trim(p)) END), '+') AS code FROM documents")(
    lambda s, d: table(s, d, "documents").withColumn("l", F.upper(F.concat("lang", F.when(F.col("doc_id") % 3 == 0, "+vn").when(F.col("doc_id") % 3 == 1, " + CN").otherwise("")))).select("doc_id", F.array_join(F.transform(F.split("l", r"\+"), lambda p: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANG.items() for x in kv]), F.trim(p)), F.lower(F.trim(p)))), "+").alias("code"))
)
query("jn17_first_match", "SELECT p_type, p_brand, coalesce(min_by(p_size, p_partkey), -1) AS size FROM part WHERE p_size < 20 GROUP BY 1, 2")(lambda s, d: top_per_key(table(s, d, "part").where("p_size < 20"), ["p_type", "p_brand"], [F.col("p_partkey")]).select("p_type", "p_brand", F.coalesce("p_size", F.lit(-1)).alias("size")))
