"""Queries that write files of each kind and read them back, in the folder that driver and executors share."""

from __future__ import annotations

import json
import zlib
from html import escape

from pyspark.sql import functions as F

from foliant.operators.scratch import Scratch
from foliant.plans.q_layout import NEXT, fold_sql
from foliant.registry import query, table
from foliant.sources import files, sinks
from foliant.streaming.state import DualLimiter, TokenBucket, ordered_fold

#: Files that a task makes or reads at a time.
FILES = 64
#: Folders that files are dealt to by name, so that none holds more than tasks can list: 1,800 files each of seven million.
FOLDERS = 4096


def _dealt(make):
    def run(*row):
        name, data = make(*row)
        return f"{zlib.crc32(name.encode()) % FOLDERS:03x}/{name}", data

    return run


def _folder(s, frame, make, name):
    """The folder with a file per row, for readers, in folders of a bounded number."""
    scratch = Scratch(s, name)
    path = scratch.path("files")
    path = path if "://" in path else f"file://{path}"
    scratch.write(sinks.write_files(frame, path, _dealt(make)), "manifest", rows=FILES)
    return path


def _read(s, frame, name):
    """What a reader finds, written once, a few files at a time."""
    return Scratch(s, name).write(frame, "read", rows=FILES)


def _number(path="path"):
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


def _texts(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _text_file(doc_id, text, k):
    return f"{doc_id}.txt", text.encode(("utf-8", "utf-8-sig", "utf-16", "utf-8")[k])


query("src02_text_files", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' ELSE 'utf-8' END AS encoding, md5(coalesce(text, '')) AS digest FROM documents")(
    lambda s, d: _read(
        s, files.read_documents(s, _folder(s, _texts(s, d).withColumn("k", (F.col("doc_id") % 4).cast("int")), _text_file, "texts"))
        .select(_number().alias("doc_id"), "encoding", F.md5("text").alias("digest")), "texts")
)
STRIPPED = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"


def _paragraphs(doc_id, text):
    return sinks.docx_file(str(doc_id), "\n\n".join(text.split("\n")))


query("src05_docx_paragraphs", f"SELECT doc_id, CAST(len({STRIPPED}) AS INTEGER) AS paragraphs, md5(array_to_string({STRIPPED}, chr(10) || chr(10))) AS digest FROM documents")(
    lambda s, d: _read(
        s, files.read_documents(s, _folder(s, _texts(s, d), _paragraphs, "docx"))
        .select(_number().alias("doc_id"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n\n", -1))).alias("paragraphs"), F.md5("text").alias("digest")), "docx")
)


def _book(conv_id, texts):
    return sinks.epub_file(str(conv_id), f"Conversation {conv_id}", [f"<h1>Turn {k + 1}</h1><p>{escape(t)}</p>" for k, t in enumerate(texts)])


def books(s, d):
    """An EPUB per conversation, a chapter per turn."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    return _folder(s, table(s, d, "conversations").groupBy("conv_id").agg(turns.alias("texts")), _book, "books")


query("snk12_epub_chapters", "SELECT conv_id, CAST(count(*) AS INTEGER) AS chapters FROM conversations GROUP BY conv_id")(
    lambda s, d: _read(s, files.read_epub_layout(s, books(s, d)), "books").groupBy(_number().alias("conv_id")).agg(F.count_distinct("chapter_id").cast("int").alias("chapters"))
)
query("src18_epub_layout", r"SELECT conv_id, CAST(k AS INTEGER) AS chapter, text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations) WHERE text <> ''")(
    lambda s, d: _read(s, files.read_epub_layout(s, books(s, d)), "books").where("not text rlike '^Turn [0-9]+$'")
    .select(_number().alias("conv_id"), F.regexp_extract("chapter_id", r"(\d+)$", 1).cast("int").alias("chapter"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
)


def glossary(s, d):
    """A dictionary under other names, with semicolons between and blanks under the first alias of some rows."""
    part = table(s, d, "part").select(
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("Original_Term_Chinese"), F.col("p_name").alias("CN"), F.col("p_type").alias("Category"), F.col("p_partkey").cast("string").alias("Note"),
    )
    path = Scratch(s, "glossary").path("csv")
    part.write.mode("overwrite").csv(path, header=True, sep=";", quoteAll=True, escape='"')
    return files.read_dictionary(s, path)


query("src13_glossary", "SELECT CAST(p_partkey AS VARCHAR) AS Notes, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE p_name END AS Original_Term_CN, p_type AS Type, '' AS Translated_Term_VI FROM part")(
    lambda s, d: glossary(s, d).select("Notes", "Original_Term_CN", "Type", "Translated_Term_VI")
)


def relations(s, d):
    """A relation table with a fixed header, of which one column is blank and one is left out."""
    rows = table(s, d, "nation").select(F.col("n_name").alias("Character_A"), F.col("n_regionkey").cast("string").alias("Character_B"), F.lit("pattern").alias("Type"), F.lit("x").alias("ignored"))
    path = Scratch(s, "relations").path("csv")
    sinks.write_dictionary(rows, path, ["Character_A", "Character_B", "Type", "Notes"])
    return files.read_dictionary(s, path, files.RELATION_COLUMNS)


query("src14_relations", "SELECT n_name AS Speaker_ID, CAST(n_regionkey AS VARCHAR) AS Listener_ID, 'pattern' AS Type, '' AS Notes FROM nation")(lambda s, d: relations(s, d).select("Speaker_ID", "Listener_ID", "Type", "Notes"))


def _profile(key, name, size):
    return f"{key}.json", json.dumps({"style": {"name": name, "size": size}, "rules": [name, size]}).encode()


query("src15_profiles", "SELECT p_partkey, p_name AS name, p_size AS size FROM part")(
    lambda s, d: files.read_profile(s, _folder(s, table(s, d, "part").select("p_partkey", "p_name", "p_size"), _profile, "profiles"))
    .select(_number().alias("p_partkey"), F.try_variant_get("profile", "$.style.name", "string").alias("name"), F.try_variant_get("profile", "$.rules[1]", "int").alias("size"))
)
query("src17_progress", "SELECT doc_id AS chunk_id, md5(coalesce(text, '')) AS digest FROM documents")(
    lambda s, d: _read(s, files.read_progress(s, _folder(s, _texts(s, d), sinks.chunk_file, "progress")), "progress").select("chunk_id", F.md5("text").alias("digest"))
)


def metrics(s, d):
    path = Scratch(s, "metrics").path("json")
    sinks.write_metrics(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most")), path)
    return s.read.schema("event_type string, n long, most double, exported_at timestamp").json(path)


query("snk05_metrics", "SELECT event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1")(lambda s, d: metrics(s, d).select("event_type", "n", "most"))


def residuals(s, d):
    """Turns appended in two writes."""
    path = Scratch(s, "residuals").path("json")
    turns = table(s, d, "conversations").select("conv_id", "turn", "text")
    for k in (0, 1):
        sinks.append_residuals(turns.where(F.col("turn") % 2 == k), path)
    return s.read.schema(turns.schema).json(path)


query("snk04_residuals", "SELECT conv_id, turn, text FROM conversations")(residuals)


def plain_lines(s, d):
    path = Scratch(s, "lines").path("txt")
    sinks.write_text(table(s, d, "nation").select(F.concat_ws("\t", "n_nationkey", "n_name").alias("text")), path)
    return s.read.text(path).select(F.col("value").alias("line"))


query("snk07_text_lines", "SELECT CAST(n_nationkey AS VARCHAR) || chr(9) || n_name AS line FROM nation")(plain_lines)


def _dual(limiter, row):
    return row["event_id"], limiter.consume(row["at"], row["amount"])


@query("st03_dual_limiter", fold_sql("allowed, requests, amount, tm", "value <= 250 AS allowed, CASE WHEN value <= 250 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS requests, CASE WHEN value <= 250 THEN 250 - value ELSE 250.0::DOUBLE END AS amount, tm",
    f"""SELECT user_id, k, event_id, q >= 1 AND a >= v AS allowed, CASE WHEN q >= 1 AND a >= v THEN q - 1 ELSE q END AS requests, CASE WHEN q >= 1 AND a >= v THEN a - v ELSE a END AS amount, tm
      FROM (SELECT e.user_id, e.k, e.event_id, e.tm, e.value AS v, CASE WHEN e.tm > r.tm THEN least(2.0::DOUBLE, requests + (e.tm - r.tm) * (2.0::DOUBLE / 3600.0::DOUBLE)) ELSE requests END AS q, CASE WHEN e.tm > r.tm THEN least(250.0::DOUBLE, amount + (e.tm - r.tm) * (250.0::DOUBLE / 3600.0::DOUBLE)) ELSE amount END AS a FROM {NEXT})""", "allowed"))
def dual_limiter(s, d):
    """Two requests and 250 units an hour for each user; a request passes only if both limits allow it."""
    timed = table(s, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("amount"))
    limiter = lambda: DualLimiter(TokenBucket(2 / 3600, 2), TokenBucket(250 / 3600, 250))
    return ordered_fold(timed, "user_id", ["at", "event_id"], limiter, _dual, "event_id bigint, allowed boolean")
