import random

from pyspark.sql import functions as F

from foliant.operators.matching import find_terms, join_terms


def test_join_gives_what_one_pattern_gives(spark):
    rnd = random.Random(5)
    pieces = ["the", "of", "of the", "the end", "End", "x2", "_a", "théâtre", "剑", "剑法", "法", "世界", "世 界", " ", "  ", ".", ", ", "\n", "a"]
    terms = ["the", "of the", "the end", "end", "a", "x2", "théâtre", "剑法", "法世", "世界", "法", "the end of the", "世a", "éa"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (None, "the end"), (902, "the " * 20_000 + "剑法")], "doc_id bigint, text string")
    want = {(r.doc_id, t) for r in docs.select("doc_id", find_terms(F.col("text"), terms).alias("t")).collect() for t in r.t or []}
    table = spark.createDataFrame([(t,) for t in terms] + [(None,), ("",), ("the",)], "term string")
    got = [(r.doc_id, r.term) for r in join_terms(docs, table).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert join_terms(docs, table.limit(0)).count() == join_terms(docs.limit(0), table).count() == 0


def test_terms_too_many_to_broadcast(spark, monkeypatch):
    from foliant.operators import matching

    monkeypatch.setattr(matching, "BROADCAST_TERMS", 0)
    test_join_gives_what_one_pattern_gives(spark)
