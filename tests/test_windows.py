import duckdb
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import foliant.plans  # noqa: F401
from foliant import registry
from foliant.operators.windows import framed, global_row_number, group_row_number, running_past, trailing_count


def _rows(spark, n):
    base = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    return base.withColumn("g", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 1000 != 7, F.col("id") % 1000))


def test_ranks_of_many_rows_with_a_payload(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 2_000_000
        global_row_number(_rows(spark, n), ["id"]).write.parquet(f"{tmp_path}/all")
        got = spark.read.parquet(f"{tmp_path}/all")
        assert got.count() == n and got.where("place <> id + 1").isEmpty()
        n = 500_000
        group_row_number(_rows(spark, n), "g", ["id"]).write.parquet(f"{tmp_path}/groups")
        got = spark.read.parquet(f"{tmp_path}/groups")
        own = W.partitionBy("g")
        wrong = got.withColumns({"want": F.row_number().over(own.orderBy("id")), "size": F.count("*").over(own)}).where("want <> k or size <> n")
        assert got.count() == n and wrong.isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nulls_ties_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (2, 1), (2, None), (1, 5), (2, 1)], "a int, b int")
    got = sorted((r.place, r.a, r.b) for r in global_row_number(df, ["a", "b"]).collect())
    assert got == [(1, None, 1), (2, 1, 5), (3, 2, None), (4, 2, 1), (5, 2, 1)]
    assert global_row_number(df.limit(0), ["a", "b"]).count() == 0
    assert group_row_number(df.limit(0), "a", ["b"]).count() == 0


def test_blocks_of_a_hot_key_equal_one_window(spark):
    df = spark.range(400).select(F.col("id"), F.when(F.col("id") % 3 != 0, F.lit(1)).when(F.col("id") < 390, F.col("id") % 5).alias("key"), (F.col("id") * 37 % 101).cast("double").alias("v"), F.timestamp_seconds(F.col("id") * 17 % 997).alias("ts"))
    df = df.withColumn("ts", F.when(F.col("id") % 50 != 0, F.col("ts")))
    own = W.partitionBy("key").orderBy("id")
    got = framed(df, "key", ["id"], 4, lambda w: {"m": F.sum("v").over(w), "n": F.count("*").over(w)}, block=7)
    want = df.withColumns({"m": F.sum("v").over(own.rowsBetween(-4, 0)), "n": F.count("*").over(own.rowsBetween(-4, 0))})
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    past = own.rowsBetween(W.unboundedPreceding, -1)
    got = running_past(df, "key", ["id"], "v", block=7)
    want = df.withColumns({"past_n": F.count("*").over(past), "past_sum": F.sum("v").over(past), "is_last": F.row_number().over(W.partitionBy("key").orderBy(F.desc("id"))) == 1})
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    got = trailing_count(df, "key", "ts", 60)
    want = df.withColumn("n", F.count("*").over(W.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-60_000_000, 0)))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def odd_events(spark, folder):
    """Events without a value, a user or an id, values that are no numbers; a key has at most one without an id, so the order is whole."""
    rows = spark.range(900).selectExpr("id event_id", "if(id % 10 = 9, null, id % 97) user_id", "case when id % 7 = 3 then null when id = 601 then double('nan') else id * 7919 % 8192 / 64 end value")
    rows.unionByName(spark.sql("select cast(null as bigint) event_id, user_id, double(3) value from values (5L), (6L), (null), (1000L) t(user_id)")).coalesce(2).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["mth03_adaptive_timeout", "vg07_size_ladder"])
def test_means_of_odd_events(spark, tmp_path, name):
    folder = odd_events(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, folder)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, con.execute(registry.SQL[name]).fetchall()))
