"""A training-data pipeline over ``documents``: quality, near duplicates, benchmark leaks, tokens.

Each stage works on all that its predecessor kept. Columns of documents pass through unchanged, further
columns included, whatever their names; the last stage gives each of them beside the tokens, the text apart. No stage crashes
on nulls, empty or very long texts, ties, repeated rows or an empty table; what becomes of them is stated for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontam, kn_quality, sigtree
from foliant.llm.work import Scratch


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows of a stage that ends in Python, written in batches of bounded rows and bytes.

    Left to whoever reads the stage, they would run in batches of the session's size, by default ten thousand rows, which
    the executor and its Python worker both hold.
    """
    return Scratch(spark, name).write(df, "rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the Kneser-Ney classifier accepts; empty and null texts go. Repeated rows are judged alike; ids may be null."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = kn_quality.classify(docs, labels, Scratch(spark, "quality"), keep_text=True).where("keep")
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents: that with the smallest id, of several with one id that with the least hash of its text.

    Rows are told apart by id and text, so an id that repeats with another text is another document. A row without an
    id stays only if no row of its group has one. Texts without words link with nothing and stay as they are.
    """
    scratch = Scratch(spark, "duplicates")
    groups = scratch.write(sigtree.jaccard_components(docs.select("doc_id", "text"), scratch, with_groups=True), "groups")
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("name"), "text_hash", "text_hash_2")
    # Written first, so that its size is known before Spark chooses how to join.
    kept = scratch.write(groups.where("grp is not null").groupBy("grp").agg(F.min(name).alias("k")).select("k.*"), "kept")
    one, two = sigtree.text_hashes()
    # Texts are dealt once, by name and hashes, for the join and the repeats alike.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("name"), one.alias("text_hash"), two.alias("text_hash_2"), sigtree.has_words().alias("words"))
    named = rows.where("words").join(kept, kept.columns, "left_semi").groupBy(*kept.columns).agg(F.first("row").alias("row"))
    return named.select("row").unionByName(rows.where("not words").select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaks, each row by its own text; null and empty texts stay, and so do all if there are no items."""
    return _written(spark, decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "clean")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text decoded from them, beside the columns of documents but the text.

    A null text is empty: no ids. A column of documents that bears the name of a result gives way to it.
    """
    import public_tokenizers

    return _written(spark, bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, with_columns=True), "tokens")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]
#: No stage can be expressed in SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
