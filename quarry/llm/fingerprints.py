"""Document fingerprints from closed syncmers, matched by position.

A k-mer of characters is an anchor when the smallest hash among its inner
s-mers is that of its first or last one; whether it is depends on the k-mer
alone, so an edit moves no anchors but those it touches. A fingerprint keeps all
anchors in the order of the text, each with its place. Two fingerprints are
alike by the share of their anchors in the longest chain that both have in the
same order, so an insertion costs the anchors it touches and no more.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, partitions
from quarry.llm.textkernel import mix

#: Characters of a k-mer and of its inner s-mers, for texts of all lengths.
K, S = 12, 5
#: Bytes of text in a bucket, and the most buckets (a bucket is streamed, so their size is no matter of memory).
BUCKET_BYTES, BUCKETS, SAMPLES_PER_BUCKET = 16 << 20, 1 << 14, 24
#: Up to so many pairs of places for each anchor, chains are found from the pairs, beyond it from bits; both are exact.
PAIRS_EACH = 4


def _window_hashes(code: np.ndarray, width: int) -> np.ndarray:
    n = len(code) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : i + n]
    return mix(h)


def syncmers(code: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of a sequence of code points."""
    inner = _window_hashes(code, s)
    span = k - s + 1
    n = len(inner) - span + 1
    low = inner.copy()  # sliding minimum by doubling
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    place = np.flatnonzero((inner[:n] == low) | (inner[span - 1 : span - 1 + n] == low))
    h = np.full(len(place), k, np.uint64)
    for i in range(0, k - s, s):
        h = mix(h ^ inner[place + i])
    h = mix(h ^ inner[place + k - s])
    return place, (h >> np.uint64(32)).astype(np.uint32)


def fingerprint(code: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchors in the order of the text, and the place of each.

    A text shorter than a k-mer, or without an anchor, has one: its whole content.
    """
    if len(code) >= k:
        place, h = syncmers(code, k, s)
        if len(h):
            return h, place
    if not len(code):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    whole = int.from_bytes(hashlib.blake2b(code.astype("<u4").tobytes(), digest_size=4).digest(), "little")
    return np.array([whole], np.uint32), np.zeros(1, np.int64)


_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def _digits(x: np.ndarray) -> np.ndarray:
    """Eight hexadecimal digits of each number, as bytes."""
    return _HEX[x.astype(">u4").view(np.uint8).reshape(-1, 4)].reshape(-1, 8)


def render(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """hash.place in hexadecimal, joined by spaces."""
    h, place = print_
    n = len(h)
    if not n:
        return ""
    out = np.empty((n, 18), np.uint8)
    out[:, :8], out[:, 8], out[:, 9:17], out[:, 17] = _digits(h), ord("."), _digits(place), ord(" ")
    keep = np.ones((n, 18), bool)
    for i in range(1, 8):  # no leading zeros of places
        keep[:, 8 + 8 - i] = place >= 16**i
    return out[keep][:-1].tobytes().decode()


def parse(text: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [p.split(".") for p in text.split()]
    return np.array([int(h, 16) for h, _ in pairs], np.uint32), np.array([int(p, 16) for _, p in pairs], np.int64)


def _common_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def chained(a: np.ndarray, b: np.ndarray, pairs: int = PAIRS_EACH) -> int:
    """The most elements of both sequences that match in order: their longest common subsequence, exactly."""
    first = _common_run(a, b)
    a, b = a[first:], b[first:]
    last = _common_run(a[::-1], b[::-1])
    a, b = a[: len(a) - last], b[: len(b) - last]
    both = np.intersect1d(a, b)
    if not len(both):
        return first + last
    # what only one of them has is in no match
    a, b = (np.searchsorted(both, x[np.isin(x, both)]) for x in (a, b))
    of_a, of_b = np.bincount(a, minlength=len(both)), np.bincount(b, minlength=len(both))
    if (of_a * of_b).sum() <= pairs * (len(a) + len(b)):
        # the longest rising sequence of the places in b, those of one element of a from the last to the first
        by = np.argsort(b, kind="stable")[::-1]
        of = b[by][::-1]
        low, n = len(b) - np.searchsorted(of, a, side="right"), of_b[a]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        tails: list[int] = []
        for x in by[at].tolist():
            if not tails or x > tails[-1]:
                tails.append(x)
            else:
                tails[bisect_left(tails, x)] = x
        return first + last + len(tails)
    # many repeats: the bits of a row of the table at once
    if len(a) > len(b):
        a, b = b, a
    where = [0] * len(both)
    for i, x in enumerate(a.tolist()):
        where[x] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        match = row & where[x]
        row = ((row + match) | (row - match)) & full
    return first + last + len(a) - row.bit_count()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: the part of both texts' anchors that match in order (Dice); 1 for two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    return 2 * chained(a[0], b[0]) / (len(a[0]) + len(b[0]))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last third replaced by as much, or all, of the next text's start."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _order_key(key: Column, text: Column) -> Column:
    """A string that sorts rows by falling ids, null ids last, and rows with equal ids by a hash of the text."""
    signed = F.lit(-(1 << 63))
    wide = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.concat(F.coalesce(wide(F.bitwise_not(key.bitwiseXOR(signed))), F.lit("G" * 16)), wide(F.xxhash64(text).bitwiseXOR(signed)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Rows in buckets by falling ids, and at each bucket's end the row that comes next (``bucket``, ``key``, ``ends``); and their number.

    Splitters come from a sample of the order's keys, so many ids alike are split
    by their texts; only rows alike in both stay together. The first row of each
    bucket is copied to the bucket before it, and the last bucket gets the very
    first row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    keyed = rows.withColumn("key", _order_key(F.col("doc_id"), F.col("text")))
    buckets = max(1, min(max(2 * partitions(spark), -(-size // bucket_bytes)), BUCKETS, n // 8))
    splitters = []
    if buckets > 1:
        # bounded: about SAMPLES_PER_BUCKET strings of 32 characters for each bucket
        sample = sorted(r["key"] for r in rows.sample(min(1.0, buckets * SAMPLES_PER_BUCKET / n), 23).select(_order_key(F.col("doc_id"), F.col("text")).alias("key")).collect())
        splitters = [sample[i * len(sample) // buckets] for i in range(1, buckets)] if sample else []
    if splitters:
        table = F.split(F.lit(",".join(splitters)), ",")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))])
        # binary search: the number of splitters at or below the key
        bucket = F.aggregate(steps, F.lit(0), lambda at, x: F.when((at + x <= len(splitters)) & (F.get(table, at + x - 1) <= F.col("key")), at + x).otherwise(at))
    else:
        bucket = F.lit(0)
    placed = keyed.withColumn("bucket", bucket)
    heads = {r["bucket"]: r["head"] for r in placed.groupBy("bucket").agg(F.min("key").alias("head")).collect()}  # one for each bucket
    order = sorted(heads)
    if not order:
        return placed.withColumn("ends", F.lit(False)), 1
    # the bucket that each head follows, the first one the last
    table = spark.createDataFrame([(heads[b], order[i - 1]) for i, b in enumerate(order)], "head string, follows int")
    first = Window.partitionBy("follows").orderBy("text")
    ends = placed.join(F.broadcast(table), F.col("key") == F.col("head")).withColumn("i", F.row_number().over(first)).where("i = 1")
    ends = ends.select("doc_id", "text", "key", F.col("follows").alias("bucket"), F.lit(True).alias("ends"))
    return placed.withColumn("ends", F.lit(False)).unionByName(ends), buckets


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprint whole texts and their edited texts; one row for each row of ``docs``.

    ``k`` and ``s`` set how many anchors a text has, about 2 / (k - s + 1) of its
    characters. Null texts are empty; their fingerprint is empty and like only
    other empty ones. Rows with equal ids follow each other by a hash of the text,
    null ids come last. A single row is its own next; an empty table gives no rows.
    Other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None
        out: list[tuple] = []

        def finish(following: str, code_next: tuple) -> None:
            key, text, own = held
            new = edited(text, following)
            of_new = fingerprint(codes(new), k, s)
            out.append((key, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), render(own), render(of_new), likeness(own, of_new), likeness(own, code_next)))

        def flush():
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for key, text, ends in zip(part.column("doc_id").to_pylist(), pc.fill_null(part.column("text"), "").to_pylist(), part.column("ends").to_pylist()):
                    own = fingerprint(codes(text), k, s)
                    if held:
                        finish(text, own)
                    held = None if ends else (key, text, own)
                if out:
                    yield flush()

    placed, buckets = with_next(docs, id_col, text_col, bucket_bytes)
    # by ranges of buckets, so that no task has many of them and others none
    sorted_ = placed.repartitionByRange(buckets, "bucket").sortWithinPartitions("bucket", "ends", "key", "text")
    return sorted_.select("doc_id", "text", "ends").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
