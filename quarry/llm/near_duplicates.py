"""N-gram Jaccard join over an R-tree of group counts.

A document's set is its distinct shingles, as 64-bit hashes. Shingles are hashed
into GROUPS groups; the counts of a set by group are a point, and the overlap of
two sets is at most the sum of the smaller counts. Points are packed into an
R-tree; two boxes are visited further only if the sum of the smaller upper
corners reaches the overlap that the similarity asks of their smallest sizes.
Pairs that survive are verified on the whole sets.

Random points of so many dimensions fill every box, so one tree over all points
prunes little. Points are therefore dealt to trees so that any two sets which can
reach the similarity meet: a set of n shingles goes to the n - ceil(t n) + 1 of
them that come first in an order common to all, and two similar sets share one
of those, which in the smaller set is even among the first
n - ceil(2 t n / (1 + t)) + 1. Shingles frequent in a bounded sample come last in
that order, which keeps passages that many documents share out of the way; the
order changes the cost alone, never the result. The points under a key are cut
into trees where the sizes leave a gap that no pair can bridge.

Documents with equal sets are one class from the start. In each tree the
smallest class is the pivot, and each class is first verified against the pivot
it meets in most trees, which joins families of near copies by stars instead of
all pairs. Then every tree in which several of these stars meet is searched (one
of all with the same members; a tree of two points is one test of the bound), and
only pairs of different stars come out of it, so no link that joins two
components is lost. A first turn verifies of each tree only the likeliest pairs
that would join its stars; a second turn goes once more through the trees that
had other pairs and whose stars are still apart. Trees of many points are built
by pairs of blocks of bounded size, of one band of sizes each; only bands that
can hold a pair meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, documents, partitions, release
from quarry.llm.components import components
from quarry.llm.textkernel import chunks, mix, shingle_hashes, span_hashes, words

GROUPS, WIDTH, PERCENT = 512, 5, 75
#: Groups of the points that decide whether two whole sets are brought together.
FINE = 4096
#: Documents sampled for the order, how many must have a shingle that is frequent, and the most such shingles.
ORDER_SAMPLE, ORDER_LEAST, ORDER_MOST = 4096, 4, 1 << 20
#: Least parts over which a frequent key is spread, and documents for which it gets one more; least tasks of a shuffle.
SALTS, SALT_ROWS, TASKS = 32, 1 << 18, 24
#: Points of a block of a tree, points of a leaf, and children of a node.
BLOCK, LEAF = 1024, 8
#: Bits of the filter of documents whose sets are wanted (a fixed size, so safe to broadcast).
FILTER_BITS = 1 << 24


class Sets:
    """The distinct shingles of each text of a chunk, text by text, ascending."""

    def __init__(self, chunk, width: int):
        starts, lengths, bounds = words(chunk)
        tokens = span_hashes(chunk.buf, starts, lengths)
        h, edges = shingle_hashes(tokens, bounds, width)
        row = np.repeat(np.arange(chunk.rows), np.diff(edges))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hashes, self.rows = h[new], row[new]
        self.edges = np.searchsorted(self.rows, np.arange(chunk.rows + 1))
        self.sizes = np.diff(self.edges)

    def classes(self) -> np.ndarray:
        """A 64-bit digest of each set, by its sorted shingles; 0 for an empty set."""
        place = np.arange(len(self.hashes)) - self.edges[self.rows]
        each = mix(self.hashes ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        out = mix(total[self.edges[1:]] - total[self.edges[:-1]] + self.sizes.astype(np.uint64))
        out[self.sizes == 0] = 0
        return out.view(np.int64)

    def prefixes(self, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The shingles under which each set is dealt, with the row, whether it is a frequent one, and whether the set can be the smaller of a pair under it."""
        common = np.zeros(len(self.hashes), bool)
        if len(frequent):
            at = np.searchsorted(frequent, self.hashes)
            at[at == len(frequent)] = 0
            common = frequent[at] == self.hashes
        order = np.lexsort((self.hashes, common, self.rows))
        place = np.arange(len(order)) - self.edges[self.rows]
        wanted = self.sizes + (-percent * self.sizes // 100) + 1  # n - ceil(t n) + 1
        keep = place < wanted[self.rows]
        order, place = order[keep], place[keep]
        smaller = self.sizes + (-2 * percent * self.sizes // (100 + percent)) + 1
        row = self.rows[order]
        return self.hashes[order], row, common[order], place < smaller[row]

    def points(self) -> np.ndarray:
        cell = self.rows * GROUPS + (self.hashes >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64)
        return np.bincount(cell, minlength=len(self.sizes) * GROUPS).reshape(-1, GROUPS)

    def fine_point(self, i: int) -> bytes:
        counts = np.bincount((self.hashes[self.edges[i] : self.edges[i + 1]] >> np.uint64(52)).astype(np.int64), minlength=FINE)
        return packed(counts[None])[0]


def packed(points: np.ndarray) -> list[bytes]:
    """Points as bytes, one byte for a count where all are below 256, else four."""
    return [(x.astype(np.uint8) if x.max() < 256 else x.astype("<u4")).tobytes() for x in points]


def unpacked(column: pa.Array, groups: int = GROUPS) -> np.ndarray:
    """Points of bytes; one byte for a count where all rows have that, else four."""
    raw = column.to_pylist()
    if all(len(x) == groups for x in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, groups)
    rows = [np.frombuffer(x, np.uint8 if len(x) == groups else "<u4") for x in raw]
    return np.array(rows, np.int32).reshape(-1, groups)


class RTree:
    """A packed R-tree of count vectors: for each level the upper corners and the smallest sizes of its boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = LEAF):
        # near points side by side: by size, then by the counts of coarse groups
        coarse = points.reshape(len(points), 8, -1).sum(axis=2, dtype=np.int64)
        self.order = np.lexsort((*coarse.T[::-1], np.floor(np.log2(np.maximum(sizes, 1)) * 4)))
        self.fan = fan
        self.upper, self.least = [points[self.order]], [sizes[self.order]]
        while len(self.least[-1]) > 1:
            starts = np.arange(0, len(self.least[-1]), fan)
            self.upper.append(np.maximum.reduceat(self.upper[-1], starts, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], starts))

    def pairs(self, percent: int, other: RTree | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of all pairs whose summed smaller counts reach the needed overlap; i before j within one tree."""
        return self.bounded_pairs(percent, other)[:2]

    def bounded_pairs(self, percent: int, other: RTree | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs with the sums of their smaller counts."""
        me, you = self, other or self
        depth = max(len(me.least), len(you.least))
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in reversed(range(depth)):
            la, lb = min(level, len(me.least) - 1), min(level, len(you.least) - 1)
            keep, sums = [], []
            for lo in range(0, len(i), 4096):
                a, b = i[lo : lo + 4096], j[lo : lo + 4096]
                bound = np.minimum(me.upper[la][a], you.upper[lb][b]).sum(axis=1, dtype=np.int64)
                sums.append(bound)
                keep.append((100 + percent) * bound >= percent * (me.least[la][a] + you.least[lb][b]))
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            i, j, sums = i[keep], j[keep], np.concatenate(sums or [i])[keep]
            if level:
                if la == level:
                    i, j = self._children(i, j, len(me.least[level - 1]))
                if lb == level:
                    j, i = self._children(j, i, len(you.least[level - 1]))
                if other is None:
                    ahead = i <= j
                    i, j = i[ahead], j[ahead]
        if other is None:
            apart = i < j
            i, j, sums = i[apart], j[apart], sums[apart]
        return me.order[i], you.order[j], sums

    def _children(self, i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        kids = (i[:, None] * self.fan + np.arange(self.fan)).ravel()
        own = np.repeat(j, self.fan)
        there = kids < n
        return kids[there], own[there]


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that at least ORDER_LEAST of at most ORDER_SAMPLE documents have, ascending."""
    sample = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDER_SAMPLE)

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), lower=True):
                u, n = np.unique(Sets(c, width).hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])

    chosen = sample.select(F.col("doc_id").alias("chosen")).distinct()
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["chosen"], "left_semi").select("text")
    found = rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {ORDER_LEAST}").orderBy(F.desc("n"), "h").limit(ORDER_MOST).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def _bits(docs: DataFrame) -> np.ndarray:
    """A filter of fixed size with the bit of each doc_id set; at most FILTER_BITS / 64 rows reach the driver."""
    slot = F.pmod(F.col("doc_id"), F.lit(FILTER_BITS))
    words_ = docs.where("doc_id IS NOT NULL").select(F.floor(slot / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words_.column("w").to_numpy()] = words_.column("bits").to_numpy()
    return out.view(np.uint8)


def _class_sets(docs: DataFrame, each: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, n, point, shingles) of the wanted classes, from the text of one document of each; the point has FINE groups.

    Documents without an id always pass the filter, so their classes are found too.
    """
    chosen = each.join(wanted, "c", "left_semi").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    bits = docs.sparkSession.sparkContext.broadcast(_bits(chosen))

    def run(batches):
        has, done = np.unpackbits(bits.value, bitorder="little").astype(bool), set()
        for batch in batches:
            ids = batch.column("doc_id")
            known = has[ids.fill_null(0).to_numpy() % FILTER_BITS] | ids.is_null().to_numpy(zero_copy_only=False)
            texts = batch.column("text").filter(pa.array(known))
            for c in chunks(texts, lower=True) if len(texts) else ():
                sets = Sets(c, width)
                own = sets.classes()
                rows = [i for i, k in enumerate(own.tolist()) if sets.sizes[i] and not (k in done or done.add(k))]
                if rows:
                    shingles = [sets.hashes[sets.edges[i] : sets.edges[i + 1]].tobytes() for i in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(sets.sizes[rows]), pa.array([sets.fine_point(i) for i in rows], pa.binary()), pa.array(shingles, pa.binary())], ["c", "n", "point", "shingles"])

    found = docs.select("doc_id", "text").mapInArrow(run, "c long, n long, point binary, shingles binary")
    return found.join(wanted, "c", "left_semi").dropDuplicates(["c"])


def _bounded(pairs: DataFrame, points: DataFrame, percent: int, groups: int = GROUPS) -> DataFrame:
    """The pairs (a, b) whose summed smaller counts reach the needed overlap."""

    def run(batches):
        for batch in batches:
            bound = np.zeros(batch.num_rows, np.int64)
            for lo in range(0, batch.num_rows, 256):
                x, y = (unpacked(batch.column(k).slice(lo, 256), groups) for k in ("pa", "pb"))
                bound[lo : lo + 256] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            keep = (100 + percent) * bound >= percent * (batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = points.select(F.col("c").alias("b"), F.col("point").alias("pb"), F.col("n").alias("nb"))
    two = points.select(F.col("c").alias("a"), F.col("point").alias("pa"), F.col("n").alias("na"))
    rows = pairs.join(one, "b").join(two, "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return rows.select("a", "b", "pa", "na", "pb", "nb").mapInArrow(run, "a long, b long")


def _checked(docs: DataFrame, each: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The candidate pairs that reach the similarity; sets are made anew from the texts of their classes."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    sets = cut(_class_sets(docs, each, wanted, width))
    near = cut(_bounded(pairs, sets.select("c", "n", "point"), percent, FINE))
    release(docs.sparkSession)
    found = cut(_verified(near, sets, percent))
    release(docs.sparkSession, wanted, sets, near)
    return found


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity on their whole sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb"), F.col("n").alias("nb"))
    two = sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na"))
    rows = pairs.join(one, "b").join(two, "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _runs(batches, keys: list[str]):
    """Whole runs of equal keys of sorted batches, as tables; what is unfinished waits."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        last = np.flatnonzero(change)
        same = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(last):
            held.append(batch.slice(0, last[-1] + 1))
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(last[-1] + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _trees(key: np.ndarray, n: np.ndarray, smaller: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and size: places of those that may have a partner under their key, and a number for each tree.

    Of a pair, the smaller set must have the key where it counts for the smaller one, and the sizes must agree.
    """
    at = np.arange(len(key))
    follows = np.zeros(len(key), bool)
    follows[:-1] = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
    last = np.maximum.accumulate(np.where(smaller, at, -1))  # the last one at or before a row that can be the smaller
    before = np.concatenate([[-1], last[:-1]]) if len(key) else last
    led = (before >= 0) & (key[before] == key) & (100 * n[before] >= percent * n)
    kept = np.flatnonzero((smaller & follows) | led)
    k, m = key[kept], n[kept]
    cut_here = np.ones(len(kept), bool)
    cut_here[1:] = (k[1:] != k[:-1]) | (100 * m[:-1] < percent * m[1:])
    return kept, np.cumsum(cut_here) - 1


def _dealt(docs: DataFrame, rows: int, width: int, percent: int) -> DataFrame:
    """(key, common, c, pivot) of classes that meet others in a tree; pivot is the smallest class there."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs, width))  # at most ORDER_MOST
    salts = max(SALTS, -(-rows // SALT_ROWS))  # a frequent key may be in any part of all rows

    def emit(batches):
        done = np.zeros(0, np.int64)  # a class is dealt once from each partition
        for batch in batches:
            for c in chunks(batch.column("text"), lower=True):
                sets = Sets(c, width)
                ids = sets.classes()
                fresh = np.zeros(len(ids), bool)
                fresh[np.unique(ids, return_index=True)[1]] = True
                fresh &= ~np.isin(ids, done)
                done = np.concatenate([done, ids[fresh]])
                keys, row, common, smaller = sets.prefixes(frequent.value, percent)
                keep = fresh[row]
                keys, row, common, smaller = keys[keep], row[keep], common[keep], smaller[keep]
                own = ids[row]
                salt = np.where(common, own % salts, -1).astype(np.int32)  # -1: not a frequent one
                n = (sets.sizes[row] * np.where(smaller, 1, -1)).astype(np.int32)  # below 0: not as the smaller of a pair
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(salt), pa.array(n), pa.array(own)], ["key", "salt", "n", "c"])

    def meet(batches):
        for t in _runs(batches, ["key", "salt"]):
            key, salt, n, c = (t.column(k).to_numpy() for k in ("key", "salt", "n", "c"))
            smaller, n = n > 0, np.abs(n)
            order = np.lexsort((c, n, salt, key))
            key, salt, n, c, smaller = (x[order] for x in (key, salt, n, c, smaller))
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (c[1:] != c[:-1])
            key, salt, n, c, smaller = (x[once] for x in (key, salt, n, c, smaller))
            plain = np.flatnonzero(salt < 0)
            kept, tree = _trees(key[plain], n[plain], smaller[plain], percent)
            at = plain[kept]
            if len(at):
                pivot = np.minimum.reduceat(c[at], np.flatnonzero(np.diff(tree, prepend=-1)))[tree]
                least = np.minimum.reduceat(n[at], np.flatnonzero(np.diff(tree, prepend=-1)))[tree]
                name = mix(key[at].view(np.uint64) ^ (least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.zeros(len(at), bool)), pa.array(c[at]), pa.array(pivot)], ["key", "common", "c", "pivot"])
            at = np.flatnonzero(salt >= 0)  # a spread key may meet itself in another part
            if len(at):
                new = np.ones(len(at), bool)
                new[1:] = (key[at][1:] != key[at][:-1]) | (salt[at][1:] != salt[at][:-1])
                pivot = np.minimum.reduceat(c[at], np.flatnonzero(new))[np.cumsum(new) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.ones(len(at), bool)), pa.array(c[at]), pa.array(pivot)], ["key", "common", "c", "pivot"])

    dealt = docs.select("text").mapInArrow(emit, "key long, salt int, n int, c long")
    placed = dealt.repartition(max(partitions(spark), TASKS), "key", "salt").sortWithinPartitions("key", "salt")
    return placed.mapInArrow(meet, "key long, common boolean, c long, pivot long")


def _forest(a: np.ndarray, b: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """Places of the likeliest pairs that join all stars which the pairs (a, b) of stars join, without a circle."""
    parent, kept = {}, []

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    order = np.lexsort((b, a, -likeness))
    for at, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(at)
    return np.array(kept, np.int64)


def _tree_pairs(groups: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """Candidate pairs (a, b) of different stars from a tree of each (key, i, j); rows have c, star, block, n, point.

    With ``forest`` only so many of a tree's pairs as would join its stars, the
    likeliest first; ``again`` is then the key of a tree that has others.
    """

    def run(batches):
        for t in _runs(batches, ["key", "i", "j"]):
            key, i, j, block, c, star, n = (t.column(k).to_numpy() for k in ("key", "i", "j", "block", "c", "star", "n"))
            points = unpacked(t.column("point"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(key))
            two = (stop - start) == 2
            a = start[two & (i[start] == j[start])]
            reach = [(100 + percent) * np.minimum(points[x], points[x + 1]).sum(axis=1, dtype=np.int64) >= percent * (n[x] + n[x + 1]) for x in np.array_split(a, len(a) // 4096 + 1)]
            a = a[np.concatenate(reach)]
            parts, again = [(a, a + 1)], [np.zeros(len(a), bool)]
            if (two & (i[start] != j[start])).any() or not two.all():
                for s, e in zip(start, stop):
                    if i[s] != j[s]:
                        left, right = s + np.flatnonzero(block[s:e] == i[s]), s + np.flatnonzero(block[s:e] == j[s])
                        if not len(left) or not len(right):
                            continue
                        a, b, overlap = RTree(points[left], n[left]).bounded_pairs(percent, RTree(points[right], n[right]))
                        a, b = left[a], right[b]
                    elif e - s > 2:
                        a, b, overlap = RTree(points[s:e], n[s:e]).bounded_pairs(percent)
                        a, b = s + a, s + b
                    else:
                        continue
                    apart = star[a] != star[b]
                    a, b, overlap = a[apart], b[apart], overlap[apart]
                    more = False
                    if forest:
                        some = _forest(star[a], star[b], overlap / (n[a] + n[b]))
                        more = len(some) < len(a)
                        a, b = a[some], b[some]
                    parts.append((a, b))
                    again.append(np.full(len(a), more))
            a, b = (np.concatenate(x) for x in zip(*parts))
            keep = star[a] != star[b]
            a, b, more = a[keep], b[keep], np.concatenate(again)[keep]
            found = np.unique(np.stack([np.minimum(c[a], c[b]), np.maximum(c[a], c[b]), np.where(more, key[a], 0), more], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2], mask=found[:, 3] == 0)], ["a", "b", "again"])

    return groups.mapInArrow(run, "a long, b long, again long")


def _links(docs: DataFrame, each: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of all classes that link with another, root common to a component."""
    spark = docs.sparkSession
    met = cut(_dealt(docs, each.count(), width, percent))
    release(spark)
    points = each.where("n_shingles > 0").select("c", F.col("n_shingles").alias("n"), "point").join(met.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.max("n").alias("n"), F.max("point").alias("point"))
    points = cut(points)
    # of a spread key's parts the smallest pivot; elsewhere the key's own
    roots = met.where("common").groupBy("key").agg(F.min("pivot").alias("root"), F.max("c").alias("most")).where("root < most").select("key", "root")
    spread = met.where("common").join(roots, "key")
    plain = met.where("NOT common").select("c", F.col("pivot").alias("p"))
    meetings = plain.union(spread.select("c", F.col("root").alias("p"))).where("p < c").groupBy("c", "p").count()
    best = meetings.groupBy("c").agg(F.max_by("p", F.struct("count", -F.col("p"))).alias("p"))
    stars = _checked(docs, each, cut(_bounded(best.select(F.col("p").alias("a"), F.col("c").alias("b")), points, percent)), width, percent)
    # the likeliest pairs join most stars, then every pair of the stars that are left is a candidate
    again = None
    for forest in (True, False):
        joined = components(stars)
        rows = met.select("key", "c").join(again, "key", "left_semi") if again is not None else met.select("key", "c")
        rows = cut(rows.join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("star", F.coalesce("root", "c")).select("key", "c", "star"))
        members = [F.sum(F.xxhash64("c", F.lit(k)).bitwiseAND(F.lit((1 << 40) - 1))).alias(f"m{k}") for k in (1, 2, 3)]
        several = rows.groupBy("key").agg(F.min("star").alias("s0"), F.max("star").alias("s1"), F.count(F.lit(1)).alias("m"), F.min("c").alias("a"), F.max("c").alias("b"), *members).where("s0 < s1")
        groups = cut(several.groupBy("m", "a", "b", "m1", "m2", "m3").agg(F.min("key").alias("key")).select("key", "m", "a", "b"))
        couples = _bounded(groups.where("m = 2").select("a", "b"), points, percent)
        some = rows.join(groups.where("m > 2").select("key", "m"), "key").join(points, "c")
        pairs = _tree_pairs(_blocks(some, percent), percent, forest)
        # two classes that meet alone are checked in the first turn, and need no second
        pairs = cut(pairs.unionByName(couples, allowMissingColumns=True) if forest else pairs)
        stars = cut(stars.union(_checked(docs, each, pairs.select("a", "b").distinct(), width, percent)))
        # keys with the same members have gone by the smallest of them, and do so again
        again = cut(pairs.where("again IS NOT NULL").select(F.col("again").alias("key")).distinct()) if forest else None
        release(spark, rows, groups, pairs)
    release(spark, points, met)
    return components(stars)


def _blocks(some: DataFrame, percent: int) -> DataFrame:
    """Rows (key, m, c, star, n, point) dealt to tasks by (key, i, j): whole small trees, pairs of blocks of large ones.

    A large tree's points are in bands of sizes, each a factor below 100 / percent
    wide, and a band is in blocks of about BLOCK points; a block meets those of its
    own band and of the next ones as far as a pair can reach. Blocks are counted
    for each key and band, so a hot key is split by its measured size.
    """
    spark = some.sparkSession
    step = float(np.log(100 / percent))
    some = some.withColumn("band", F.when(F.col("m") > BLOCK, F.floor(F.log(F.col("n").cast("double")) / step)).otherwise(0).cast("int"))
    large = some.where(f"m > {BLOCK}")
    sizes = large.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    above = sizes.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up"))
    below = sizes.select("key", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down"))
    dealt = sizes.join(above, ["key", "band"], "left").join(below, ["key", "band"], "left").fillna(0, ["up", "down"])
    # a block is band * 2^16 + its number; its own band's blocks, those of the band above and of the one below
    names = lambda band, n: F.transform(F.filter(F.sequence(F.lit(0), n), lambda x: x < n), lambda x: band * 65536 + x)
    band = F.col("band")
    others = F.concat(names(band, F.col("blocks")), names(band + 1, F.col("up")), names(band - 1, F.col("down")))
    spread = large.join(dealt, ["key", "band"]).withColumn("block", band * 65536 + F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("o", F.explode(others))
    columns = ["key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "c", "star", "n", "point"]
    small = some.where(f"m <= {BLOCK}").withColumn("block", F.lit(0)).withColumn("o", F.lit(0))
    rows = small.select(*columns).unionByName(spread.select(*columns))
    return rows.repartition(max(partitions(spark), TASKS), "key", "i", "j").sortWithinPartitions("key", "i", "j", "c")


def _rooted(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n_shingles, c, root) of each row; h is a hash of the text, root common to a component (null without shingles)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), lower=True):
                sets = Sets(c, width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.lo, c.rows), batch.column("h").slice(c.lo, c.rows), pa.array(sets.sizes), pa.array(sets.classes()), pa.array(packed(sets.points()), pa.binary())], ["doc_id", "h", "n_shingles", "c", "point"])

    each = cut(rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(run, "doc_id long, h long, n_shingles long, c long, point binary"))
    linked = cut(_links(rows, each, width, percent))
    own = each.drop("point").join(linked.withColumnRenamed("node", "c"), "c", "left")
    return own.withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "c")))


def similar_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, class_id.

    A null text is empty: such rows, and those of white space alone, have no
    shingles and are linked with nothing; fewer words than ``width`` give their
    whole sequence as one. Rows with equal sets have one class_id. component_id is
    the smallest id in reach (ids that are null don't count). An empty table gives
    no rows; other columns are not read.
    """
    own = _rooted(docs, width, percent, id_col, text_col)
    least = own.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return own.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.col("c").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each component, all columns as they are.

    It is the row with the smallest id; of several with that id, the one whose
    text has the smallest hash, and rows alike in id and text stay together. Rows
    with null ids or without shingles stay.
    """
    own = _rooted(docs, width, percent, id_col, text_col).where("root IS NOT NULL AND doc_id IS NOT NULL")
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    gone = own.join(first, "root").where("doc_id <> first.doc_id OR h <> first.h").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    h = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col("__id")) & (h == F.col("__h")), "left_anti")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
