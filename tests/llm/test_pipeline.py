from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import SMALL
from tests.llm.test_sigtree import brute


def test_stages_against_brute_force(spark, scratch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from foliant.llm import decontam

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "tokens"]
    stage = dict(corpus_pipeline.STAGES)
    good = scratch.write(stage["quality"](spark, docs, SMALL), "good")
    assert good.columns == docs.columns and 0.6 * docs.count() < good.count() < docs.count()
    one = scratch.write(stage["near_duplicates"](spark, good, SMALL), "one")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in one.collect()} == {d for d, _, c in brute(rows) if d == c}
    clean = scratch.write(stage["decontamination"](spark, one, SMALL), "clean")
    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in one.collect()}
    want = {d for d, t in texts.items() if not any(decontam.edit_distance(i, decontam.normalise(t)) <= decontam.MAX_EDIT * len(i) for i in items)}
    assert {r.doc_id for r in clean.collect()} == want
    done = stage["tokens"](spark, clean, SMALL).collect()
    assert {r.doc_id: r.ids for r in done} == {d: library.encode(texts[d], add_special_tokens=False).ids for d in want}


def test_run_and_odd_columns(spark, tmp_path):
    names = ["keep", "bits", "kept_id", "n", "row", "words", "name", "text_hash", "ids"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", *[f"'x' as {n}" for n in names])
    odd = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = odd.unionByName(odd.limit(5)).unionByName(odd.limit(2).withColumns({"doc_id": F.col("doc_id") + 100000, "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    plain = corpus_pipeline.run(spark, SMALL)
    assert {"lang", "source", "n_chars", "keep", "bits", "row", "words"} <= set(got.columns)
    got, plain = ([(r.doc_id, r.ids_sha256) for r in x.collect()] for x in (got, plain))
    # Copies without an id and repeated rows go; only the trusted rows that set quantiles are the same in both runs.
    assert len(got) == len(set(got)) and set(got) == set(plain)


def test_near_duplicates_by_row(spark):
    a, b = ("a river runs through the old town and under the bridge", "nothing of this kind was ever written down in any book")
    rows = [(3, a, 1), (5, b, 2), (5, a, 3), (5, a, 3), (None, b, 4), (None, "one more text that stands alone in all of these", 5), (7, "", 6), (7, "", 6), (8, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words int")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[5], *rows[6:]], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_stages_leave_no_python_to_the_reader(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "Python" not in plan, name
