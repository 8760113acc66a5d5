"""N-gram Jaccard join by signature trees.

A text's set is its distinct five-word shingles. A signature tree holds sets in its leaves; each node
holds the OR of its sets' token bitmaps, the range of their sizes and the most tokens that any of them
loses by sharing a bit. For two nodes no pair below can have more in common than that loss plus the
common bits, nor than the smaller set, so a dual traversal leaves out node pairs whose greatest possible
overlap is too small, and an exact intersection decides what is left.

To spread the join over tasks without losing a link:

1. Equal sets become one class. Only classes are compared.
2. Shingles are put in one global order, by hash, but with the very frequent ones (mergeable heavy
   hitters of all texts, at most HEAVY_SHARE of them) last, rarest first. Two sets of Jaccard similarity t share
   l of their first n - ceil(t n) + l shingles; these are their keys, with l = ceil(n / KEY_SHARE).
3. Rounds: classes with the same r-th key meet in blocks of bounded size, each joined by a signature tree;
   components of the links found leave one class each for the next round. This links most of what is
   alike at the price of one copy of each set.
4. The exact rest: of all keys, those that still stand in two components; classes with too few of them go, and
   of the others only the rarest keys count by which linked classes are sure to meet, so passages common to
   many texts that share little else bring nothing together. A small block is a single leaf; pairs that bitmaps
   leave open are verified on whole sets. Classes of large blocks form families by the keys that are left, so each
   is sent once however many keys it shares; signature trees of each family (large ones as pairs of chunks, but
   none of sizes that cannot be linked nor of one component) find the links.

Links between two classes of one component change no component and are not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.graph import connected_components
from foliant.llm.tokens import mix, shingle_sets, shingles, slices, string_bytes, words
from foliant.llm.work import Scratch, map_batches, tasks

WORDS = 5
#: Similarity as a fraction: link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
ROUNDS, BLOCK, FANOUT, SMALL = 2, 1024, 8, 24
#: Blocks and chunks are bounded in shingles too: to so many times BLOCK.
CHUNK_TOKENS = 1024
#: Keys are the upper 48 bits of a shingle's hash: enough to tell shingles apart, and a quarter less to shuffle.
KEY_SHIFT = 16
#: One in so many of a set's shingles is a key that it shares with a linked set.
KEY_SHARE = 12
#: log2 of the bits of the widest bitmap in a tree; larger sets fill theirs and are told apart by exact overlaps.
WIDEST = 14
HEAVY_SHARE, HEAVY_LEAST = 1 << 20, 16
#: Shingles of which a task counts repeats at once.
COUNTED = 1 << 22
#: Rows of an Arrow batch of keys.
KEY_ROWS = 50_000
#: Bits of the bitmap that keeps sets nobody asked for out of a shuffle.
FILTER_BITS = 1 << 26


def needed(a, b):
    """Least overlap of linked sets of sizes a and b: DEN * i >= NUM * (a + b - i)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def least_common(n: int) -> int:
    """How many keys a set of size n shares with a linked set that is at least as large."""
    return max(1, -(-n // KEY_SHARE))


def prefix_length(n: int) -> int:
    """Keys of a set: n - NUM/DEN n + 1 would make linked sets share one, each further one makes them share one more."""
    return n - (-(-NUM * n // DEN)) + least_common(n)


def width(n: np.ndarray) -> np.ndarray:
    """log2 of the bits of a bitmap: at least twice the size of the set."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def bitmap(items: np.ndarray, log2: int) -> np.ndarray:
    """Bits of the items; fold() of a wider bitmap gives the same as a narrower one made directly."""
    bits = np.zeros(1 << log2, np.uint8)
    bits[(mix(items) & np.uint64((1 << log2) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray) -> np.ndarray:
    """Half the width: bit k of the result is bit k or bit k + half."""
    if maps.shape[1] == 1:
        raise ValueError("a bitmap of one word is not folded")
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


class SignatureTree:
    """Levels from the leaves (level 0) to the root; a node's children are FANOUT neighbours of the level below."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, order: np.ndarray | None = None, fanout: int = FANOUT, comp: np.ndarray | None = None):
        """``comp``: labels; nodes all of whose sets bear one and the same label are not compared."""
        self.order = np.lexsort((sizes,)) if order is None else order
        size, bits = sizes[self.order].astype(np.int64), maps[self.order]
        lost = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        label = -1 - np.arange(len(size)) if comp is None else comp[self.order]
        self.fanout, self.levels = fanout, [(bits, size, size, lost, label, label)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, lost, first, last = self.levels[-1]
            at = np.arange(0, len(low), fanout)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))


def _possible(one, two, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of nodes a of ``one`` and b of ``two`` may hold linked sets."""
    bits_a, low_a, high_a, lost_a, first_a, last_a = (x[a] for x in one)
    bits_b, low_b, high_b, lost_b, first_b, last_b = (x[b] for x in two)
    ok = (DEN * high_a >= NUM * low_b) & (DEN * high_b >= NUM * low_a)
    ok &= (first_a != last_a) | (first_b != last_b) | (first_a != first_b) | (first_a < 0)
    most = np.minimum(np.minimum(high_a, high_b), np.minimum(lost_a, lost_b) + np.bitwise_count(bits_a & bits_b).sum(1).astype(np.int64))
    return ok & (most >= needed(low_a, low_b))


def dual_traversal(one: SignatureTree, two: SignatureTree | None = None, step_bytes: int = 16 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (i, j): members that may be linked, each unordered pair once within a tree (two is None)."""
    same = two is None
    two = one if same else two
    if not len(one.levels[0][1]) or not len(two.levels[0][1]):
        return
    step = max(64, step_bytes // one.levels[0][0][0].nbytes)
    stack = [(len(one.levels) - 1, len(two.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        u, v, a, b = stack.pop()
        if len(a) > step:
            stack += [(u, v, a[step:], b[step:]), (u, v, a[:step], b[:step])]
            continue
        keep = _possible(one.levels[u], two.levels[v], a, b)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if u == v == 0:
            if same:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield one.order[a], two.order[b]
            continue
        # The higher node opens, both if level with each other, so that leaves meet nodes before leaves.
        if u >= v and u:
            a, b = _children(one, u, a, b)
            u -= 1
            if same and u + 1 == v:
                b, a = _children(two, v, b, a)
                v -= 1
                a, b = a[a <= b], b[a <= b]
        else:
            b, a = _children(two, v, b, a)
            v -= 1
        stack.append((u, v, a, b))


def _children(tree: SignatureTree, level: int, node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    below = len(tree.levels[level - 1][1])
    child = (node[:, None] * tree.fanout + np.arange(tree.fanout)).ravel()
    real = child < below
    return child[real], np.repeat(other, tree.fanout)[real]


class Links:
    """Union-find over members of a block."""

    def __init__(self, labels: np.ndarray):
        self.up = list(range(len(labels)))
        first: dict[int, int] = {}
        for k, x in enumerate(labels.tolist()):
            self.up[k] = first.setdefault(x, k)

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def join_sets(items: list[np.ndarray]) -> list[tuple[int, int]]:
    """(member, least member linked to it) for the links among sets given as sorted arrays."""
    sizes = np.array([len(x) for x in items], np.int64)
    log2 = min(WIDEST, int(width(sizes).max(initial=6)))
    maps = np.stack([bitmap(x, log2) for x in items])
    # Alike sets stand side by side in the tree: by their least items.
    least = np.array([x[min(1, len(x) - 1)] for x in items], np.uint64)
    links = Links(np.arange(len(items)))
    for a, b in dual_traversal(SignatureTree(sizes, maps, np.lexsort((least, sizes)))):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if links.find(i) != links.find(j):
                common = len(np.intersect1d(items[i], items[j], assume_unique=True))
                if common >= needed(len(items[i]), len(items[j])):
                    links.join(i, j)
    return [(k, root) for k in range(len(items)) if (root := links.find(k)) != k]


def heavy_shingles(docs: DataFrame, scratch: Scratch) -> pa.Table:
    """(shingle, n): at most HEAVY_SHARE shingles, among them all in over 2/HEAVY_SHARE of all occurrences.

    Each task counts its texts in parts and passes on shingles with over 1/HEAVY_SHARE of a part, so all
    counts together lack less than that share of the total. Repeats within a text count too: all that matters
    is that the order is one for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            x = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            least = int(max(8, len(x) // HEAVY_SHARE + 1))
            # In sorted order, a value stands again ``least - 1`` places on just if it occurs so often.
            often = np.unique(x[: len(x) - least + 1][x[: len(x) - least + 1] == x[least - 1 :]]) if len(x) >= least else x[:0]
            n = np.searchsorted(x, often, "right") - np.searchsorted(x, often, "left")
            yield pa.RecordBatch.from_arrays([pa.array(np.append(often.view(np.int64), 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(often), np.int64), len(x)))], ["shingle", "n", "total"])

        for batch in batches:
            data, off = string_bytes(batch.column("text"))
            for i, j in slices(off):
                x, _ = shingles(words(data, off, i, j), WORDS)
                held.append(x)
                size += len(x)
                if size >= COUNTED:
                    yield from out()
                    held, size = [], 0
        yield from out()

    counts = map_batches(docs.select("text"), run, "shingle long, n long, total long").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # At most HEAVY_SHARE shingles a part of COUNTED occurrences, and in the end HEAVY_SHARE of all.
    counts = scratch.write(counts, "heavy")
    total = counts.agg(F.sum("total")).first()[0] or 0
    return counts.where(F.col("n") >= max(HEAVY_LEAST, total // HEAVY_SHARE + 1)).select("shingle", "n").toArrow()


class Order:
    """The global order of shingles: by hash, heavy ones last by count."""

    def __init__(self, heavy: pa.Table):
        x, n = heavy.column("shingle").to_numpy().view(np.uint64), heavy.column("n").to_numpy()
        by = np.lexsort((x, n))
        rank = np.empty(len(x), np.int64)
        rank[by] = np.arange(len(x))
        sort = np.argsort(x)
        self.heavy, self.rank = x[sort], rank[sort]

    def prefix(self, items: np.ndarray) -> np.ndarray:
        k = prefix_length(len(items))
        if not len(self.heavy) or not len(items):
            return items[:k]
        at = np.minimum(np.searchsorted(self.heavy, items), len(self.heavy) - 1)
        is_heavy = self.heavy[at] == items
        if not is_heavy.any():
            return items[:k]
        tail = items[is_heavy][np.argsort(self.rank[at[is_heavy]])]
        return np.concatenate([items[~is_heavy], tail])[:k]


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(items).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(items + np.uint64(77))).view(np.int64)) if len(items) else 0


def _profiles(docs: DataFrame, order: Order) -> DataFrame:
    """(doc_id, th, th2, n, f1, f2, prefix) per row; the prefix only at the first of equal sets in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, seen = shared.value, set()
        for batch in batches:
            n, f1, f2, keys = [], [], [], []
            for _, x in shingle_sets(batch.column("text"), WORDS):
                f = fingerprint(x)
                n.append(len(x))
                f1.append(f[0])
                f2.append(f[1])
                keys.append(None if f in seen or not len(x) else (o.prefix(x) >> np.uint64(KEY_SHIFT)).view(np.int64))
                if len(seen) < 1 << 18:
                    seen.add(f)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), batch.column("th2"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "th2", "n", "f1", "f2", "prefix"])

    return map_batches(docs.select("doc_id", "th", "th2", "text"), run, f"doc_id {kind}, th long, th2 long, n long, f1 long, f2 long, prefix array<long>")


def _fetch(docs: DataFrame, wanted: DataFrame, maps_only: bool = False) -> DataFrame:
    """The columns of wanted(th, f1, f2, n, ...) with ``items``, the set's sorted shingles (or its bitmap), made from the texts anew.

    A bitmap of the wanted hashes of texts, of fixed size, tells tasks which texts nobody asked for. A task makes the
    set of a text (by two hashes of 64 bits) that it meets again only once.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.col("th"), F.lit(FILTER_BITS))
    parts = wanted.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod(F.col("bit"), F.lit(32768))).alias("bits")).collect()
    flags = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        flags[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = spark.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag, seen = shared.value, set()
        for batch in batches:
            th, second = batch.column("th").to_numpy(), batch.column("th2").to_numpy()
            b = th % FILTER_BITS
            new = []
            for k in np.flatnonzero(flag[b >> 3] >> (b & 7) & 1).tolist():
                name = int(th[k]), int(second[k])
                if name not in seen:
                    new.append(k)
                    if len(seen) < 1 << 18:
                        seen.add(name)
            rows, f1, f2, n, items = [], [], [], [], []
            for k, x in shingle_sets(batch.column("text").take(pa.array(new, pa.int64())), WORDS):
                if len(x):
                    f = fingerprint(x)
                    rows.append(int(th[new[k]]))
                    f1.append(f[0])
                    f2.append(f[1])
                    n.append(len(x))
                    items.append((bitmap(x, int(width(np.array([len(x)]))[0])) if maps_only else x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int64()), pa.array(items, pa.binary())], ["th", "f1", "f2", "n", "items"])

    sets = map_batches(docs.select("th", "th2", "text"), run, "th long, f1 long, f2 long, n long, items binary")
    key = ["th", "f1", "f2", "n"]
    # Tasks drop their own repeats, so a text that is copied all over comes once a task.
    return wanted.join(sets, key).dropDuplicates([c for c in wanted.columns if c in (*key, "cid")])


def _block_join(group: pa.Table) -> pa.Table:
    cid = group.column("cid").to_pylist()
    edges = join_sets([np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()])
    return pa.table([pa.array([cid[i] for i, _ in edges], pa.int64()), pa.array([cid[j] for _, j in edges], pa.int64())], ["a", "b"])


def _large_join(group: pa.Table) -> pa.Table:
    """(comp, comp linked to it) for links of different components in a chunk of a family, or between two chunks."""
    one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
    n, comp, chunk = (group.column(c).to_numpy() for c in ("n", "comp", "chunk"))
    items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
    log2 = min(WIDEST, int(width(np.array([n.max() * 8]))[0]))
    maps = np.stack([bitmap(x, log2) for x in items])
    links, edges = Links(comp), []

    def tree(rows: np.ndarray) -> SignatureTree:
        return SignatureTree(n[rows], maps[rows], np.lexsort((n[rows], comp[rows])), comp=comp[rows])

    if one == two:
        left = right = np.arange(len(comp))
        pairs = dual_traversal(tree(left))
    else:
        left, right = np.flatnonzero(chunk == one), np.flatnonzero(chunk == two)
        pairs = dual_traversal(tree(left), tree(right)) if len(left) and len(right) else ()
    for a, b in pairs:
        for i, j in zip(left[a].tolist(), right[b].tolist(), strict=True):
            if links.find(i) != links.find(j):
                if len(np.intersect1d(items[i], items[j], assume_unique=True)) >= needed(n[i], n[j]):
                    links.join(i, j)
                    edges.append((comp[i], comp[j]))
    return pa.table([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first one, cut anew so that equal values stand together; holds no more than a batch and one run."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy() for c in batch.columns]
        held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None:
        yield held


def _by_key(df: DataFrame) -> DataFrame:
    return df.repartition(tasks(df.sparkSession), "key").sortWithinPartitions("key")


def _contested(keyed: DataFrame) -> DataFrame:
    """Rows of keyed(key, cid, n, comp), no key of which is heavy, whose key stands in two components; with its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cid, n, comp in _runs(batches):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            many = np.repeat(np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first), size)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (key, cid, n, comp, np.repeat(size, size))], ["key", "cid", "n", "comp", "members"])

    return map_batches(_by_key(keyed.select("key", "cid", "n", "comp")), run, "key long, cid long, n long, comp long, members long")


def _telling(hits: DataFrame) -> DataFrame:
    """Of hits(key, cid, n, comp, members), the keys by which linked classes are sure to meet.

    Linked sets share at least f = ceil(ceil(NUM n / DEN) / KEY_SHARE) of these keys, n the size of either one. So a
    class with fewer goes, and of K keys its K - f + 1 rarest are enough: the rarest key that two classes share has at
    least f - 1 more of them after it in the order of both.
    """
    fewest = F.ceil(F.ceil(F.col("n") * NUM / DEN) / KEY_SHARE).cast("int")
    own = hits.groupBy("cid", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("keys")).where(F.size("keys") >= fewest)
    return own.select("cid", "n", "comp", F.inline(F.slice("keys", F.lit(1), F.size("keys") - fewest + 1)))


def _small_blocks(hits: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components with sizes that may be linked, over keys of at most SMALL rows; with the components.

    Such a block is one leaf of a signature tree; all leaves of a batch are compared at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cid, n, comp in _runs(batches):
            found = []
            for step in range(1, SMALL):
                if step >= len(key):
                    break
                i = np.flatnonzero(key[:-step] == key[step:])
                if not len(i):
                    break
                j = i + step
                ok = (comp[i] != comp[j]) & (DEN * n[i] >= NUM * n[j]) & (DEN * n[j] >= NUM * n[i])
                i, j = i[ok], j[ok]
                turn = cid[i] > cid[j]
                i, j = np.where(turn, j, i), np.where(turn, i, j)
                found.append(np.stack([cid[i], cid[j], comp[i], comp[j]], 1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
            for k in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 16), c]) for c in range(4)], ["a", "b", "comp_a", "comp_b"])

    return map_batches(_by_key(hits.select("key", "cid", "n", "comp")), run, "a long, b long, comp_a long, comp_b long").distinct()


def _possible_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs(a, b, comp_a, comp_b, n_a, n_b, x, y), those whose bitmaps x and y allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) > len(y):
                    x = fold(x[None])[0]
                while len(y) > len(x):
                    y = fold(y[None])[0]
                common = int(np.bitwise_count(x & y).sum())
                lost = min(n_a[k] - int(np.bitwise_count(x).sum()), n_b[k] - int(np.bitwise_count(y).sum()))
                keep[k] = min(common + lost, n_a[k], n_b[k]) >= needed(n_a[k], n_b[k])
            yield batch.select(["a", "b", "comp_a", "comp_b"]).filter(pa.array(keep))

    return map_batches(pairs, run, "a long, b long, comp_a long, comp_b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    for side, value in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("items").alias(value)), side)
    return pairs


def _verified(pairs: DataFrame) -> DataFrame:
    """(a, b): components of those of pairs(comp_a, comp_b, x, y) whose whole sets x and y are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                linked.append(len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in (batch.column("comp_a"), batch.column("comp_b"))], ["a", "b"])

    return map_batches(pairs.select("comp_a", "comp_b", "x", "y"), run, "a long, b long")


def _small_links(hits: DataFrame, docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between components whose classes share a key of at most SMALL rows."""
    few = scratch.write(_small_blocks(hits), "few", rows=KEY_ROWS)
    maps = scratch.write(_fetch(docs, ids.join(_ends(few), "cid", "left_semi"), maps_only=True).select("cid", "n", "items"), "maps")
    pairs = scratch.write(_possible_pairs(_with_sets(few, maps)), "pairs")
    scratch.sweep("few", "maps")
    sets = scratch.write(_fetch(docs, ids.join(_ends(pairs), "cid", "left_semi")).select("cid", "n", "items"), "sets")
    edges = scratch.write(_verified(_with_sets(pairs, sets)), "small-edges")
    scratch.sweep("pairs", "sets")
    return edges


def _large_links(hits: DataFrame, docs: DataFrame, ids: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between components whose classes share a key of over SMALL rows."""
    hits = scratch.write(hits, "large")
    stars = hits.join(hits.groupBy("key").agg(F.min("cid").alias("b")), "key").select(F.col("cid").alias("a"), "b")
    family = connected_components(stars, scratch, "families").select(F.col("id").alias("cid"), F.col("component").alias("family"))
    member = hits.select("cid", "n", "comp").distinct().join(family, "cid", "left").withColumn("family", F.coalesce("family", "cid"))
    # Chunks of bounded rows and bytes; a component that fits in one is not cut.
    weight = F.ceil(F.greatest(F.col("members") / block, F.col("tokens") / (block * CHUNK_TOKENS)))
    mass = (F.count("*").alias("members"), F.sum("n").alias("tokens"))
    whole = member.groupBy("family").agg(*mass, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("family", weight.cast("int").alias("chunks"))
    parts = member.groupBy("family", "comp").agg(*mass).select("family", "comp", weight.cast("int").alias("parts"))
    placed = member.join(whole, "family").join(parts, ["family", "comp"])
    chunk = F.pmod(F.xxhash64("comp") + F.pmod(F.xxhash64("cid"), F.col("parts")), F.col("chunks")).cast("int")
    placed = scratch.write(placed.select("family", "cid", "n", "comp", chunk.alias("chunk")), "placed")
    chunks = placed.groupBy("family", "chunk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("small"), F.max("n").alias("big"))
    one, two = (chunks.select("family", *[F.col(c).alias(f"{c}_{k}") for c in ("chunk", "lo", "hi", "small", "big")]) for k in (1, 2))
    apart = ~((F.col("lo_1") == F.col("hi_1")) & (F.col("lo_2") == F.col("hi_2")) & (F.col("lo_1") == F.col("lo_2")))
    near = (F.col("big_1") * DEN >= F.col("small_2") * NUM) & (F.col("big_2") * DEN >= F.col("small_1") * NUM)
    pairs = one.join(two, "family").where((F.col("chunk_1") <= F.col("chunk_2")) & apart & near).select("family", F.col("chunk_1").alias("one"), F.col("chunk_2").alias("two"))
    pairs = scratch.write(pairs, "chunk-pairs")
    sets = scratch.write(_fetch(docs, ids.join(placed.select("cid"), "cid", "left_semi")).select("cid", "items"), "large-sets")
    sides = pairs.select("family", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("chunk"))
    work = placed.join(sides, ["family", "chunk"]).join(sets, "cid")
    edges = scratch.write(work.groupBy("family", "one", "two").applyInArrow(_large_join, "a long, b long"), "large-edges")
    scratch.sweep("large", "placed", "chunk-pairs", "large-sets")
    return edges


def _compose(comp: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) of ids of ``comp`` whose components are ids of ``more``, and of the ids of ``more``."""
    step = more.select(F.col("id").alias("component"), F.col("component").alias("next"))
    return comp.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component")).unionByName(more)


def text_hashes(text_column: str = "text") -> tuple[Column, Column]:
    """Two hashes of 64 bits that tell texts apart; a null text is empty."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def has_words(text_column: str = "text") -> Column:
    """Whether a text has a word, and so a set that is not empty."""
    return F.coalesce(F.col(text_column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def jaccard_components(documents: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS, block: int = BLOCK, with_groups: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) per row, ``with_groups`` with grp and text_hashes.

    ``grp`` names the row's component, whatever ids its rows have, and is null for an empty set; the two text_hashes are those
    of text_hashes().

    component_id is the smallest id reachable by links. Texts that are null, empty or without words have
    an empty set, link with nothing and are their own component; a row without id has the component of its equals, if any
    has one. Repeated rows are equal sets and give a row each. Texts of any length are read whole, a task holding one at a
    time. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    docs = documents.select(F.col(id_column).alias("doc_id"), text.alias("text"), *(h.alias(n) for h, n in zip(text_hashes(text_column), ("th", "th2"), strict=True)))
    heavy = heavy_shingles(docs, scratch)
    rows = scratch.write(_profiles(docs, Order(heavy)), "rows")
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("low"), F.min("th").alias("th"), F.first("prefix", ignorenulls=True).alias("prefix"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = scratch.write(rows.drop("prefix"), "plain")
    scratch.sweep("heavy", "rows")
    comp = spark.createDataFrame([], "id long, component long")
    for r in range(rounds):
        # One class of each component goes on.
        active = classes.select("cid", "th", "f1", "f2", "n", F.get("prefix", F.lit(r)).alias("key")).where("key is not null")
        if r:
            active = active.join(comp.select(F.col("id").alias("cid")), "cid", "left_anti")
        counts = active.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).where("members > 1")
        chunk = F.pmod(F.xxhash64("cid"), F.ceil(F.greatest(F.col("members") / block, F.col("tokens") / (block * CHUNK_TOKENS)))).cast("int")
        wanted = scratch.write(active.join(counts, "key").select("th", "f1", "f2", "n", "cid", "key", chunk.alias("chunk")), f"wanted-{r}")
        # A class is in one block a round, and a block gives stars, so the edges are components as they are.
        edges = _fetch(docs, wanted).groupBy("key", "chunk").applyInArrow(_block_join, "a long, b long")
        edges = scratch.write(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), f"edges-{r}")
        comp = scratch.write(_compose(comp, edges), f"comp-{r}") if r else edges
        scratch.sweep(f"wanted-{r}", *([f"edges-{r}"] if r else []))
    named = classes.join(comp.select(F.col("id").alias("cid"), F.col("component").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    keyed = named.select(F.explode("prefix").alias("key"), "cid", "n", "comp")
    if heavy.num_rows:
        often = np.unique(heavy.column("shingle").to_numpy().view(np.uint64) >> np.uint64(KEY_SHIFT))
        table = F.broadcast(spark.createDataFrame(pa.table({"key": pa.array(often.view(np.int64))})))
        hot = scratch.write(keyed.join(table, "key", "left_semi"), "hot")
        several = hot.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
        hits = _contested(keyed.join(table, "key", "left_anti")).unionByName(hot.join(several, "key"))
    else:
        hits = _contested(keyed)
    hits = scratch.write(_telling(scratch.write(hits, "hits-all", rows=KEY_ROWS)), "hits")
    scratch.sweep("hits-all", "hot")
    ids = classes.select("cid", "th", "f1", "f2", "n")
    small = _small_links(hits.where(F.col("members") <= SMALL), docs, ids, scratch)
    large = _large_links(hits.where(F.col("members") > SMALL), docs, ids, block, scratch)
    comp = scratch.write(_compose(comp, connected_components(small.unionByName(large), scratch, "components")), "comp")
    scratch.sweep("hits", "small-edges", "large-edges", *(f"comp-{k}" for k in range(1, rounds)), "edges-0")
    label = comp.select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    named = classes.select("cid", "f1", "f2", "n", "low").join(label, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    done = scratch.write(named.join(least, "comp").select("f1", "f2", "n", "component_id", F.col("comp").alias("grp")), "done")
    # What is left for the result to read: the rows and their components.
    scratch.sweep("classes", "comp")
    out = rows.join(done, ["f1", "f2", "n"], "left")
    more = ["grp", F.col("th").alias("text_hash"), F.col("th2").alias("text_hash_2")] if with_groups else []
    return out.select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all rows of ``documents`` at Jaccard 0.75 on five-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "sigtree")).select("doc_id", "n_shingles", "component_id")
