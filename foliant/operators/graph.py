"""Connected components, and groups of keys that share labels, closed under reachability.

Components come from alternating large-star and small-star steps (Kiveris et al., 2014). Every step is a
partial aggregation (the smallest neighbour) and an equi-join that adaptive execution can split, so a vertex with
very many neighbours is no single task's burden. Nothing but one flag per round reaches the driver. Rounds go on until
every component is a star around its smallest vertex; their number grows with the logarithm of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.scratch import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: no centre has an edge to another, and no vertex two centres."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
    degree = edges.select(ends.alias("e")).groupBy("e.x").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    return degree.where("out > 1 or (out > 0 and into > 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) for each vertex of ``edges(a, b)`` that is not the smallest of its component.

    ``component`` is the smallest id reachable. Null ends and self-loops are ignored; an empty table has no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, k = scratch.write(e, f"{name}-0"), 0
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        k += 1
        e = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def linked_groups(labels: DataFrame, key: str, label: str, shared: int = 2) -> DataFrame:
    """(key, group_id): the least key reachable over pairs with at least ``shared`` labels in common.

    Keys with the same combination of ``shared`` labels are linked to the least of them, so no pair of keys is ever
    formed. A key has few labels; its combinations are formed in its own row.
    """
    sets = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("l"))
    combos = F.transform("l", lambda x: F.array(x))
    for _ in range(shared - 1):
        combos = F.flatten(F.transform(combos, lambda c: F.transform(F.filter(F.col("l"), lambda x: x > F.element_at(c, -1)), lambda x: F.concat(c, F.array(x)))))
    scratch = Scratch(labels.sparkSession, "groups")
    keys = scratch.write(sets.select(key, combos.alias("combos")), "keys")
    rows = keys.select(F.col(key).alias("a"), F.explode("combos").alias("c"))
    low = rows.groupBy("c").agg(F.min("a").alias("b"))
    found = connected_components(rows.join(low, "c").select("a", "b"), scratch)
    return keys.select(key).join(found.withColumnRenamed("id", key), key, "left").select(key, F.coalesce("component", key).alias("group_id"))
