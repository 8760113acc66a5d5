"""Embedding near-dedup: a forest of random-projection trees with spill, compared within leaves.

Equal vectors of a label become one class with a multiplicity, so copies never meet as pairs. A forest
is fitted on a bounded sample of the classes: every node projects on a random direction and splits at
the sample's median; a vector within ``SPILL`` of a split goes down both sides. Every class is routed
through every tree. Classes that share a label and a leaf are compared by cosine in double precision. A
pair that shares several leaves counts in the least of them only, so sums of links need no list of pairs.

A tree is descended only as far as the size of the vector's label asks for, so rare labels stay whole and
a hot one has leaves of the same size. A leaf of more than ``LEAF_ROWS`` classes is cut into chunks, and each pair of chunks is a task's work of
bounded size; all its pairs are still compared. Each comparison emits, per class, its number of links
and one edge to a root of its local component; components of those edges are found by
``connected_components``. The forest is the only thing broadcast; its size is fixed by TREES and DEPTH.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.graph import connected_components
from foliant.llm.work import Scratch, map_batches

COSINE = 0.98
TREES, MAX_DEPTH, SPILL = 6, 12, 0.5
SAMPLE, LEAF_TARGET, LEAF_ROWS = 16384, 128, 1024
#: Vectors of one length up to which no forest is fitted for them.
FEW = 2048
#: Labels up to which their sizes are broadcast.
BROADCAST_LABELS = 100_000
SEED = 20240


@dataclass
class Forest:
    """Per tree: a direction per node and its threshold, nodes in heap order; ``spill`` is a distance along a direction."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int
    spill: float

    def leaves(self, x: np.ndarray, depth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of unit vectors, each down to its own depth; leaves are numbered over the nodes of all trees."""
        rows, found = [], []
        depth = np.full(len(x), self.depth) if depth is None else np.minimum(depth, self.depth)
        for t in range(len(self.directions)):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth + 1):
                there = depth[row] == level
                rows.append(row[there])
                found.append(node[there] + t * 2 ** (self.depth + 1))
                row, node = row[~there], node[~there]
                if not len(row):
                    break
                side = np.einsum("ij,ij->i", x[row], self.directions[t][node]) - self.cuts[t][node]
                left, right = side <= self.spill, side > -self.spill
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return np.concatenate(rows), np.concatenate(found)


def fit(sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, cosine: float = COSINE, seed: int = SEED) -> Forest:
    """``spill`` is in units of the typical projection of the difference of two vectors just at ``cosine``."""
    rng = np.random.default_rng(seed)
    n, d = 2**depth - 1, sample.shape[1]
    directions = rng.standard_normal((trees, max(n, 1), d))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts = np.zeros((trees, max(n, 1)))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(n):
            own = members.pop(node)
            at = sample[own] @ directions[t, node]
            cuts[t, node] = np.median(at) if len(at) else 0.0
            members[2 * node + 1], members[2 * node + 2] = own[at <= cuts[t, node]], own[at > cuts[t, node]]
    return Forest(directions, cuts, depth, spill * float(np.sqrt(2 * (1 - cosine) / d)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 1/2..1: exact, and no product overflows or vanishes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def usable(vector, label):
    """A column: the row may link at all."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each component of the edges (a, b) among n points."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def compare(cosine: float):
    """The work on one leaf, or one pair of chunks of it."""

    def run(group: pa.Table) -> pa.Table:
        leaf = group.column("leaf")[0].as_py()
        one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
        cid, mult, chunk = (group.column(c).to_numpy() for c in ("cid", "mult", "chunk"))
        raw = scaled(_matrix(group.column("vector")))
        norm = np.sqrt((raw * raw).sum(1))
        order = group.column("leaves").combine_chunks()
        a, b = (np.arange(len(cid)),) * 2 if one == two else (np.flatnonzero(chunk == one), np.flatnonzero(chunk == two))
        names, flat = np.unique(order.flatten().to_numpy(), return_inverse=True)
        before = int(np.searchsorted(names, leaf))
        owner = np.repeat(np.arange(len(cid)), np.diff(order.offsets.to_numpy()))
        member = np.zeros((len(cid), before), np.float32)
        early = flat < before
        member[owner[early], flat[early]] = 1
        links, at, to = np.zeros(len(cid), np.int64), [], []
        for i in range(0, len(a), LEAF_ROWS):
            for j in range(i if one == two else 0, len(b), LEAF_ROWS):
                x, y = a[i : i + LEAF_ROWS], b[j : j + LEAF_ROWS]
                near = raw[x] @ raw[y].T / norm[x][:, None] / norm[y] >= cosine
                if one == two and i == j:
                    near &= np.tri(len(x), len(y), -1, bool)
                if not near.any():
                    continue
                p, q = np.nonzero(near)
                at.append(x[p])
                to.append(y[q])
                if before:
                    near &= member[x] @ member[y].T == 0
                links[x] += near @ mult[y]
                links[y] += mult[x] @ near
        at, to = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, to))
        root = _local_roots(len(cid), at, to)
        hit = np.unique(np.concatenate([at, to])).astype(np.int64)
        return pa.table([pa.array(cid[hit]), pa.array(links[hit]), pa.array(cid[root[hit]])], ["cid", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, trees: int = TREES, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link
    with nothing, and so do vectors of different lengths, of which there may be any number. A row without an id links with
    nothing and has no component. Rows that repeat an id are vectors of their own; a pair of exactly ``cosine`` is linked. Finite
    components of any size count. Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    base = base.withColumn("vector", F.when(usable(F.col("vector"), F.col("label")) & F.col("id").isNotNull(), F.col("vector")))
    some = base.where("vector is not null")
    classes = some.groupBy("label", "vector").agg(F.count("*").alias("mult"), F.min("id").alias("low"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # One row per length: those with many vectors have a forest each, the others are compared label by label.
    sizes = {r.d: r.n for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    large = sorted(d for d, n in sizes.items() if n > FEW)
    parts = [_links(classes.where(F.size("vector") == d), scratch, cosine, trees, f"links-{d}") for d in large]
    if len(sizes) > len(large):
        rest = classes.where(~F.size("vector").isin(large)) if large else classes
        few = rest.select("cid", F.concat_ws(" ", F.size("vector").cast("string"), "label").alias("label"), "mult", "vector", F.array(F.lit(0).cast("long")).alias("leaves"))
        parts.append(_compare(few, scratch, cosine, "links-few"))
    links = spark.createDataFrame([], "cid long, links long, root long")
    for p in parts:
        links = links.unionByName(p)
    sums = links.groupBy("cid").agg(F.sum("links").alias("links"))
    edges = links.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    comp = connected_components(edges, scratch)
    named = classes.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    done = named.join(least, "component").join(sums, "cid", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    done = scratch.write(done, "done")
    alone = F.when(F.col("vector").isNull(), F.col("id"))
    out = base.join(done, ["label", "vector"], "left").select(F.col("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", alone).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumnRenamed("id", id_column)


def _links(classes: DataFrame, scratch: Scratch, cosine: float, trees: int, name: str) -> DataFrame:
    """(cid, links, root) rows of all leaves over classes of one vector length."""
    spark = classes.sparkSession
    sample = classes.select("vector").orderBy(F.xxhash64("cid")).limit(SAMPLE).toArrow()
    sizes = scratch.write(classes.groupBy("label").agg(F.count("*").alias("n")), f"{name}-labels")
    most = sizes.agg(F.max("n")).first()[0]
    deepest = int(min(MAX_DEPTH, max(0, np.log2(max(1, sample.num_rows / 4)))))
    depth = int(np.clip(np.ceil(np.log2(max(1, most / LEAF_TARGET))), 0, deepest))
    shared = spark.sparkContext.broadcast(fit(unit(_matrix(sample.column("vector"))), depth, trees, cosine=cosine))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF_TARGET))).cast("int").alias("depth")
    levels = sizes.select("label", level)
    classes = classes.join(F.broadcast(levels) if sizes.count() <= BROADCAST_LABELS else levels, "label")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, leaf = forest.leaves(unit(_matrix(batch.column("vector"))), batch.column("depth").to_numpy())
            order = np.lexsort((leaf, row))
            off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            leaves = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(leaf[order]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("cid", "label", "mult", "vector")], leaves], ["cid", "label", "mult", "vector", "leaves"])

    routed = scratch.write(map_batches(classes.select("cid", "label", "mult", "vector", "depth"), route, "cid long, label string, mult long, vector array<double>, leaves array<long>"), f"{name}-routed")
    return _compare(routed, scratch, cosine, name)


def _compare(routed: DataFrame, scratch: Scratch, cosine: float, name: str) -> DataFrame:
    """(cid, links, root) rows of all leaves of routed(cid, label, mult, vector, leaves)."""
    spread = routed.select("cid", "label", "mult", F.explode("leaves").alias("leaf"))
    sizes = spread.groupBy("label", "leaf").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / LEAF_ROWS).cast("int"))
    rows = routed.withColumn("leaf", F.explode("leaves")).join(sizes, ["label", "leaf"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("cid", "leaf"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("label", "leaf", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "cid", "mult", "vector", "leaves")
    return scratch.write(rows.groupBy("label", "leaf", "one", "two").applyInArrow(compare(cosine), "cid long, links long, root long"), name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 and more between all rows of ``embeddings`` with equal labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "forest")).select("vec_id", "n_links", "component_id", "kept")
