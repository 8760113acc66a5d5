"""Queries of titles, term replacement, prompts, geometry lines and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions import titles as T
from foliant.operators.chunking import fold_documents
from foliant.operators.model import apply_model, glossary_section
from foliant.plans.inject import INJ, injected
from foliant.plans.q_text import NL, SPLIT, strip
from foliant.registry import query, table
from foliant.streaming.state import ordered_fold

TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'chương hai: a b' WHEN 1 THEN 'HỒI 12 - dark MOON' WHEN 2 THEN 'Quyển thứ ' || p_size WHEN 3 THEN 'no title ' || p_name ELSE 'Tập mười.' END"


def titles(s, d):
    k = F.col("p_partkey") % 5
    return table(s, d, "part").select("p_partkey", F.when(k == 0, "chương hai: a b").when(k == 1, "HỒI 12 - dark MOON").when(k == 2, F.concat(F.lit("Quyển thứ "), F.col("p_size").cast("string"))).when(k == 3, F.concat(F.lit("no title "), F.col("p_name"))).otherwise("Tập mười.").alias("t"))


query("txt25_standard_titles", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Chương 2: A B' WHEN 1 THEN 'Hồi 12: Dark Moon' WHEN 2 THEN 'Quyển ' || p_size WHEN 3 THEN 'no title ' || p_name ELSE 'Tập 10' END AS out FROM part")(
    lambda s, d: titles(s, d).select("p_partkey", T.standard_title(F.col("t")).alias("out"))
)
query("txt27_heading_rewrite", "SELECT p_partkey, 'x [H1]Chương ' || p_size || ': A[/H1] y' || chr(10) || '[H3]plain[/H3]' AS out FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", T.normal_headings(F.concat(F.lit("x [H2]chương "), F.col("p_size").cast("string"), F.lit(": a[/H2] y\n[H1]plain[/H1]"))).alias("out"))
)
query("txt23_markdown", f"""WITH {INJ}, l AS (SELECT doc_id, {strip('unnest(' + SPLIT + ')')} AS line, generate_subscripts({SPLIT}, 1) AS no FROM inj), k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '(?i)^(?:chapter|chương)\\s+\\d+') THEN 'head' ELSE 'text' END AS kind FROM l),
    g AS (SELECT *, sum(CASE WHEN kind <> 'text' OR prev IS DISTINCT FROM 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS grp FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY no) AS prev FROM k)),
    p AS (SELECT doc_id, grp, min(kind) AS kind, CASE min(kind) WHEN 'blank' THEN '' WHEN 'head' THEN '## ' || min(line) ELSE string_agg(line, ' ' ORDER BY no) END AS body FROM g GROUP BY doc_id, grp),
    q AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY grp) AS before FROM p) SELECT doc_id, {strip(f"string_agg(body, {NL} ORDER BY grp)")} AS out FROM q WHERE kind <> 'blank' OR (before IS NOT NULL AND before <> 'blank') GROUP BY doc_id""")(lambda s, d: markdown(s, d))


def markdown(s, d):
    """Lines of a paragraph joined, headings marked, at most one blank line: islands of line kinds."""
    w = W.partitionBy("doc_id").orderBy("no")
    rows = injected(s, d).select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("no", "line")).withColumn("line", X.strip(F.col("line")))
    rows = rows.withColumn("kind", F.when(F.col("line") == "", "blank").when(F.col("line").rlike(r"(?iu)^(?:chapter|chương)\s+\d+"), "head").otherwise("text"))
    rows = rows.withColumn("new", (F.col("kind") != "text") | ~F.lag("kind").over(w).eqNullSafe("text")).withColumn("grp", F.sum(F.col("new").cast("int")).over(w))
    parts = rows.groupBy("doc_id", "grp").agg(F.min("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), " ").alias("body"))
    parts = parts.withColumn("body", F.when(F.col("kind") == "head", F.concat(F.lit("## "), F.col("body"))).otherwise(F.col("body"))).withColumn("before", F.lag("kind").over(W.partitionBy("doc_id").orderBy("grp")))
    kept = parts.where("kind <> 'blank' or (before is not null and before <> 'blank')")
    return kept.groupBy("doc_id").agg(X.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "body"))), lambda x: x["body"]), "\n")).alias("out"))


GLOSSARY = [("世界", "shijie", "world"), ("剑法", "", "Shijie art"), ("", "nihao", "hello")]
query("txt35_glossary_fix", f"WITH {INJ} SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text || ' SHIJIE nihao', '世界', 'world'), '剑法', 'world art'), '(?i)shijie', 'world', 'g'), '(?i)nihao', 'hello', 'g') AS out FROM inj")(
    lambda s, d: injected(s, d).select("doc_id", T.fix_glossary(F.concat("text", F.lit(" SHIJIE nihao")), GLOSSARY).alias("out"))
)
query("txt36_narrative_terms", f"WITH {INJ} SELECT doc_id, text || chr(10) || 'Lan saw that nàng left' || chr(10) || '\"Lan, hắn is here\"' || chr(10) || 'hắn alone' AS out FROM inj")(
    lambda s, d: injected(s, d).select("doc_id", T.narrative_terms(F.concat("text", F.lit('\nLan saw that hắn left\n"Lan, hắn is here"\nhắn alone')), {"Lan": "nàng"}).alias("out"))
)
query("txt37_pronoun_spans", "SELECT doc_id, unnest(['anh', 'Hắn', 'công tử']) AS pronoun FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.pronoun_spans(F.concat(F.lit("anh ấy và Hắn, thanh với công tử "), F.lit("xong")))).alias("pronoun"))
)
query("txt38_spaced_replacement", "SELECT p_partkey, p_size || ' a world b, a world. world b world' AS out FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", T.replace_spaced(F.concat(F.col("p_size").cast("string"), F.lit(" a世界b, a世界. 世界b 世界")), "世界", "world").alias("out"))
)
query("txt40_compact_terms", "SELECT p_type, string_agg(p_name || CASE WHEN p_brand <> p_name THEN '(' || p_brand || ')' ELSE '' END || '->' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '[even]' ELSE '' END, '; ' ORDER BY p_partkey) AS out FROM part GROUP BY p_type")(
    lambda s, d: table(s, d, "part").withColumn("item", T.compact_term(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise(""))).groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]), "; ").alias("out"))
)
query("txt41_batch_split", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a', ''] ELSE ['a', 'b' || chr(10) || chr(10) || 'c'] END AS parts FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", T.split_batch(F.when(F.col("doc_id") % 3 == 0, " a\n\nb ").when(F.col("doc_id") % 3 == 1, "a\n\n\n\n ").otherwise("a\n\nb\n\n c"), F.lit(2)).alias("parts"))
)
query("prj02_fixed_header", "SELECT p_name AS term, '' AS missing, CAST(p_size AS VARCHAR) AS size FROM part")(lambda s, d: table(s, d, "part").select(F.coalesce("p_name", F.lit("")).alias("term"), F.lit("").alias("missing"), F.coalesce(F.col("p_size").cast("string"), F.lit("")).alias("size")))
query("prj04_display_dictionary", "SELECT p_name AS original, min(coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, ''), p_type)) AS translated FROM part GROUP BY p_name")(
    lambda s, d: table(s, d, "part").groupBy(F.col("p_name").alias("original")).agg(F.min(F.coalesce(F.nullif(F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand")), F.lit("")), F.col("p_type"))).alias("translated"))
)
KIND = "CASE p_partkey % 4 WHEN 0 THEN 'pattern' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Character' END"


def kinds(s, d):
    k = F.col("p_partkey") % 4
    return table(s, d, "part").withColumn("kind", F.when(k == 0, "pattern").when(k == 1, "").when(k == 3, "Character"))


query("flt02_pattern_rows", f"SELECT p_partkey FROM (SELECT p_partkey, {KIND} AS kind FROM part) WHERE kind IN ('pattern', '') OR kind IS NULL")(lambda s, d: kinds(s, d).where("kind in ('pattern', '') or kind is null").select("p_partkey"))
query("flt03_narrator_rows", f"SELECT p_partkey FROM (SELECT p_partkey, {KIND} AS kind FROM part) WHERE kind IN ('narrator_reference', 'narrative_single', '') OR kind IS NULL")(lambda s, d: kinds(s, d).where("kind in ('narrator_reference', 'narrative_single', '') or kind is null").select("p_partkey"))
query("flt04_character_rows", f"SELECT DISTINCT p_name FROM (SELECT p_name, {KIND} AS kind FROM part) WHERE kind = 'Character' AND trim(p_name) <> ''")(lambda s, d: kinds(s, d).where("kind = 'Character' and trim(p_name) <> ''").select("p_name").distinct())
query("sl08_display_order", "SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand")(lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types")))


def _line(state, row):
    if state["y"] is None or abs(row["y"] - state["y"]) > 2.0:
        state["y"], state["line"] = row["y"], state["line"] + 1
    return row["user_id"], row["event_id"], state["line"]


query("wn09_words_to_lines", """WITH RECURSIVE w AS (SELECT user_id, event_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events),
    f(user_id, event_id, k, first_y, line) AS (SELECT user_id, event_id, k, y, 1::BIGINT FROM w WHERE k = 1 UNION ALL SELECT w.user_id, w.event_id, w.k, CASE WHEN abs(w.y - f.first_y) > 2.0 THEN w.y ELSE f.first_y END, CASE WHEN abs(w.y - f.first_y) > 2.0 THEN f.line + 1 ELSE f.line END FROM f JOIN w ON w.user_id = f.user_id AND w.k = f.k + 1)
    SELECT user_id, event_id, line FROM f""")(
    lambda s, d: ordered_fold(table(s, d, "events").select("user_id", "event_id", F.col("value").alias("y")), "user_id", ["y", "event_id"], lambda: {"y": None, "line": 0}, _line, "user_id bigint, event_id bigint, line bigint")
)
query("src11_ordered_rejoin", "SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS out FROM conversations GROUP BY conv_id")(lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\f").alias("out")))
REPLY = "'intro' || chr(10) || 'CSV:' || chr(10) || '```' || chr(10) || p_type || ',' || p_size || chr(10) || p_brand || ',1' || chr(10) || '```' || chr(10) || chr(10) || 'note' || chr(10) || 'CSV:' || chr(10) || 'z,' || p_partkey"


@query("ms01_table_replies", "SELECT p_partkey, 1::BIGINT AS no, p_type || ',' || p_size || chr(10) || p_brand || ',1' AS csv FROM part UNION ALL SELECT p_partkey, 2, 'z,' || p_partkey FROM part")
def table_replies(s, d):
    """Tables after each ``CSV:`` without fences, up to the first blank line after data."""
    reply = F.concat(F.lit("intro\nCSV:\n```\n"), "p_type", F.lit(","), F.col("p_size").cast("string"), F.lit("\n"), "p_brand", F.lit(",1\n```\n\nnote\nCSV:\nz,"), F.col("p_partkey").cast("string"))
    blocks = F.slice(F.split(reply, "CSV:", -1), F.lit(2), F.lit(1 << 20))
    rows = table(s, d, "part").select("p_partkey", F.posexplode(blocks).alias("no", "block"))
    own = F.filter(X.lines(X.strip(F.col("block"))), lambda x: ~X.strip(x).startswith("```"))
    rows = rows.withColumn("z", own).withColumn("first", F.array_position(F.transform("z", lambda x: X.strip(x) != ""), True))
    rows = rows.where("first > 0").withColumn("z", F.expr("slice(z, cast(first as int), size(z))")).withColumn("stop", F.array_position(F.transform("z", lambda x: X.strip(x) == ""), True))
    cut = F.when(F.col("stop") > 0, F.expr("slice(z, 1, cast(stop - 1 as int))")).otherwise(F.col("z"))
    return rows.select("p_partkey", (F.col("no") + 1).cast("long").alias("no"), F.array_join(cut, "\n").alias("csv"))


def soft_wraps(text: str) -> str:
    """Tabs become blanks; leading blanks go unless the paragraph before ended a sentence or the line is a list item."""
    import re

    out, before = [], ""
    for line in text.split("\n"):
        if not re.search(r"https?://\S+", line):
            line = re.sub(r"\s*\t+\s*", " ", line)
            own = line.lstrip("\t ")
            if own and own != line and not re.search(r"[.!?]$", before.strip()) and not re.match(r"[•·\-*]\s|\d+[.)]\s", own):
                line = own
        out.append(line)
        before = line
    return "\n".join(out)


query("ms26_soft_wraps")(lambda s, d: fold_documents(injected(s, d), lambda t: [(soft_wraps("\n\t".join(t.split("\n"))),)], "out string"))
query("mdl01_echo_model", "SELECT doc_id AS chunk_id, 'Translate:' || chr(10) || text AS response FROM documents")(lambda s, d: apply_model(table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("Translate:\n"), F.col("text")).alias("prompt"))))
query("mdl02_glossary_section", "SELECT p_brand, string_agg('**' || upper(p_type) || ':**' || chr(10) || body, chr(10) || chr(10) ORDER BY p_type) AS section FROM (SELECT p_brand, p_type, string_agg('- ' || p_name || ' → **' || p_size || '**', chr(10) ORDER BY p_partkey) AS body FROM part GROUP BY 1, 2) GROUP BY p_brand")(
    lambda s, d: glossary_section(table(s, d, "part").withColumn("line", F.concat(F.lit("- "), "p_name", F.lit(" → **"), F.col("p_size").cast("string"), F.lit("**"))), "p_brand", "p_type", "line", "p_partkey")
)
query("mdl03_relation_section", "SELECT a.n_regionkey AS region, string_agg('**Giữa ' || a.n_name || ' và ' || b.n_name || ':**', chr(10) ORDER BY a.n_name, b.n_name) AS section FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name GROUP BY 1")(lambda s, d: relation_section(s, d))


def relation_section(s, d):
    """A line for each unordered pair of a region's members."""
    n = table(s, d, "nation")
    pairs = n.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("a")).join(n.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("b")), "region").where("a < b")
    line = F.concat(F.lit("**Giữa "), "a", F.lit(" và "), "b", F.lit(":**"))
    return pairs.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", line.alias("l")))), lambda x: x["l"]), "\n").alias("section"))
