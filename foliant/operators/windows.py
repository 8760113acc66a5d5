"""Ordered operators over lines, turns and events: islands, neighbours, frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repeated(df: DataFrame, key: str, order: str, value: Column) -> Column:
    """Whether a row's value is the same as the row before has."""
    return F.coalesce(value == F.lag(value).over(W.partitionBy(key).orderBy(order)), F.lit(False))


def islands(flag: Column, key: str, order: str) -> Column:
    """Number of rows up to here at which a new segment begins."""
    return F.sum(flag.cast("long")).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def around(value: Column, key: str, order: str, before: int, after: int, sep: str = "") -> Column:
    """Values of the rows from ``before`` rows back to ``after`` rows on, joined in order."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-before, after)
    return F.array_join(F.collect_list(value).over(w), sep)


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark limits ranks before the shuffle too, so a hot key sends n rows a task."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


#: Range bounds that a row is compared with at each of two levels.
_FAN = 64


def _ranges(df: DataFrame, order: list[str]) -> Column:
    """Blocks (head, ranges) of ranges (top, before): the greatest key of each range and the number of rows in those before it.

    Only the order columns are read and shuffled; the result has a row per partition.
    """
    keys = df.select(F.struct(*order).alias("key")).repartitionByRange("key").withColumn("part", F.spark_partition_id())
    tops = keys.groupBy("part").agg(F.max("key").alias("top"), F.count("*").alias("n"))
    w = W.orderBy("top")
    tops = tops.select("top", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.floor((F.row_number().over(w) - 1) / _FAN).alias("block"))
    blocks = tops.groupBy("block").agg(F.max("top").alias("head"), F.array_sort(F.collect_list(F.struct("top", "before"))).alias("ranges"))
    return blocks.agg(F.array_sort(F.collect_list(F.struct("head", "ranges"))).alias("blocks")).scalar()


def global_row_number(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """1-based rank in a total order without sending all rows to one task.

    A first pass over the order columns alone gives range bounds and the number of rows before each range. Each row
    then finds its range by comparing its key with those bounds, and is numbered within it, so a rank depends on data
    and bounds only and never on how a shuffle happens to be cut. Nulls come first; rows with equal keys get ranks
    in any order.
    """
    key = F.struct(*[F.col(c) for c in order])
    block = F.element_at(F.col("_blocks"), F.size(F.filter(F.transform("_blocks", lambda b: b["head"]), lambda t: t < F.col("_key"))) + 1)
    place = F.element_at(F.col("_block")["ranges"], F.size(F.filter(F.col("_block")["ranges"], lambda r: r["top"] < F.col("_key"))) + 1)
    rows = df.withColumns({"_key": key, "_blocks": _ranges(df, order)}).withColumn("_block", block).withColumn("_before", place["before"])
    rows = rows.drop("_key", "_blocks", "_block")
    within = F.row_number().over(W.partitionBy("_before").orderBy(*order))
    return rows.withColumn(name, (within + F.col("_before")).cast("long")).drop("_before")


def group_row_number(df: DataFrame, key: str, order: list[str], rank: str = "k", size: str = "n") -> DataFrame:
    """1-based rank within a group and the group's size, for groups of any size.

    Ranks come from the rank in the order of (key, order) over all rows, less that of the group's first row, so
    a group that holds a third of all rows is spread over tasks like any other. Null is a group too.
    """
    placed = global_row_number(df, [key, *order], "_place")
    groups = global_row_number(df.select(key, *order), [key, *order], "_place").groupBy(F.col(key).alias("_group")).agg(F.min("_place").alias("_first"), F.count("*").alias(size))
    return placed.join(groups, F.col(key).eqNullSafe(F.col("_group"))).withColumn(rank, F.col("_place") - F.col("_first") + 1).drop("_place", "_first", "_group")


#: Rows of a key in a block of their own, so that a hot key is many tasks' work.
BLOCK_ROWS = 100_000


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, name: str = "n") -> DataFrame:
    """Adds the number of rows of the key in the last ``seconds`` seconds, those of the same instant included.

    Rows are dealt by key and span of that length; each row is counted in its own span and the next one, so a hot
    key is spread over its spans. Rows without a time count each other alone.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = F.floor(at / (seconds * 1_000_000))
    both = F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))))
    rows = df.withColumns({"_at": at, "_in": both}).withColumns({"_span": F.col("_in.span"), "_own": F.col("_in.own")}).where("_own or _at is not null")
    w = W.partitionBy(key, "_span").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn(name, F.count("*").over(w)).where("_own").drop("_at", "_in", "_span", "_own")


def framed(df: DataFrame, key: str, order: list[str], before: int, columns: Callable[[WindowSpec], dict[str, Column]], block: int | None = None) -> DataFrame:
    """Adds columns over the row and the ``before`` rows before it of its key, for keys of any size.

    A key is cut into blocks of rows by rank; the last rows of a block are seen by the next one too.
    """
    block = block or BLOCK_ROWS
    if before >= block:
        raise ValueError("a frame must be shorter than a block")
    placed = group_row_number(df, key, order, "_k", "_n").withColumn("_block", F.floor((F.col("_k") - 1) / block))
    ahead = ((F.col("_k") - 1) % block >= block - before) & (F.col("_k") - 1 + before >= (F.col("_block") + 1) * block) & (F.col("_n") > (F.col("_block") + 1) * block)
    seen = F.array_compact(F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own")), F.when(ahead, F.struct((F.col("_block") + 1).alias("b"), F.lit(False).alias("own")))))
    rows = placed.withColumn("_in", F.explode(seen)).withColumns({"_b": F.col("_in.b"), "_own": F.col("_in.own")})
    w = W.partitionBy(key, "_b").orderBy("_k").rowsBetween(-before, 0)
    return rows.withColumns(columns(w)).where("_own").drop("_k", "_n", "_block", "_in", "_b", "_own")


def running_past(df: DataFrame, key: str, order: list[str], value: str, block: int | None = None) -> DataFrame:
    """Adds past_n, past_sum and past_mean, over the rows of the key before this one, and is_last, for keys of any size.

    Rows without a value count in past_n but not in past_mean, which is null where no row before has one. As in SQL, nulls of ``order``
    come last, and is_last is the row that comes first in descending order, so one with a null only if the key has no other.
    Blocks of rows are summed first; a row adds the sums of earlier blocks to what stands before it in its own.
    """
    nulls = {f"_null{k}": F.col(c).isNull() for k, c in enumerate(order)}
    ranks = [x for pair in zip(nulls, order, strict=True) for x in pair]
    placed = group_row_number(df.withColumns(nulls), key, ranks, "_k", "_n").withColumn("_block", F.floor((F.col("_k") - 1) / (block or BLOCK_ROWS)))
    top = F.max(F.struct(*[~F.col(c) if c in nulls else F.col(c) for c in ranks], F.col("_k").alias("_last")))
    sums = placed.groupBy(key, "_block").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"), top.alias("_top"))
    past = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    earlier = sums.select(
        F.col(key).alias("_key"), F.col("_block").alias("_b"), F.sum("_s").over(past).alias("_earlier"), F.coalesce(F.sum("_c").over(past), F.lit(0)).alias("_counted"),
        F.max("_top").over(W.partitionBy(key))["_last"].alias("_last"),
    )
    met = placed.join(earlier, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    before = W.partitionBy(key, "_block").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    own = F.sum(value).over(before)
    total = F.when(F.col("_earlier").isNull() & own.isNull(), None).otherwise(F.coalesce("_earlier", F.lit(0)) + F.coalesce(own, F.lit(0)))
    added = {"past_n": F.col("_k") - 1, "past_sum": total, "past_mean": F.try_divide(total, F.col("_counted") + F.count(value).over(before)), "is_last": F.col("_k") == F.col("_last")}
    return met.withColumns(added).drop(*nulls, "_k", "_n", "_block", "_key", "_b", "_earlier", "_counted", "_last")
