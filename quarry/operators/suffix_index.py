"""A suffix index: the documents and number of suffixes of every short key, in Parquet files sorted by key.

A suffix starts at each code point of each body, and its key is its first GRAM bytes
(fewer at the end of a body). A row holds a key, a shard of the corpus, how many of
the shard's suffixes have the key, and the documents that have one. So every suffix
is counted, at a fraction of the bytes that a row for each would take. A needle no
longer than a key is counted from the rows of a range of keys; row groups and pages
outside of it are skipped. A longer one is in documents that have all keys within its
first ``key_bytes``, and its places are found in these alone.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import common_prefix, n_bytes, succ
from quarry.operators import search
from quarry.session import fresh_path
from quarry.sources import number_rows

KEY_BYTES = 16
#: Ranges of keys that one scan is narrowed to.
RANGES = 8
#: Keys of a needle whose documents are compared (any document that passes is searched), and documents up to which their ids are broadcast.
PROBES, BROADCAST_IDS = 4, 1 << 18


def suffixes(corpus: DataFrame, key_bytes: int | None = KEY_BYTES) -> DataFrame:
    """(key, uid, off) of every suffix that starts at a code point; unsorted, and without a shuffle.

    Each byte that doesn't continue a character starts one; ``key_bytes`` None: whole suffixes.
    """
    body = corpus.where("text <> ''").select("uid", F.col("text").cast("binary").alias("body"))
    rows = body.select("uid", "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - 1)).alias("off"))
    first = F.substring("body", F.col("off") + 1, F.lit(1))
    starts = rows.where(~((first >= F.lit(b"\x80")) & (first < F.lit(b"\xc0"))))
    size = F.lit(key_bytes) if key_bytes else F.octet_length("body")
    return starts.select(F.substring("body", F.col("off") + 1, size).alias("key"), "uid", "off")


#: Bytes of text whose suffixes make one partition of an index.
PARTITION_BYTES = 16 << 20


def planned_partitions(text_bytes: int, least: int = 1) -> int:
    """Range partitions of an index over so many bytes of text."""
    return max(least, -(-text_bytes // PARTITION_BYTES))


#: Bytes of a key in the files, and of text whose keys a worker sorts at once: one shard.
GRAM, SHARD_BYTES = 3, 4 << 20


def key_codes(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, place) of every suffix of the bodies in ``buf``: the key, filled up with zeros, times 4 plus its length, which keeps the order of keys."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    left = np.repeat(bounds[1:], np.diff(bounds))[at] - at
    code = np.zeros(len(at), np.int64)
    wide = np.concatenate([buf, np.zeros(GRAM, np.uint8)])
    for i in range(GRAM):
        code = (code << 8) | np.where(left > i, wide[at + i], 0)
    return code * 4 + np.minimum(left, GRAM), at


def _postings(texts: list[bytes], uids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a shard in order, their suffixes, and the documents of each: places in ``uids`` and how many."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    code, at = key_codes(np.frombuffer(b"".join(texts), np.uint8), bounds)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[at]
    pair, n = np.unique((code << 32) | owner, return_counts=True)
    code = pair >> 32
    first = np.flatnonzero(np.diff(code, prepend=-1))
    keys = [(c >> 2).to_bytes(GRAM, "big")[: c & 3] for c in code[first].tolist()]
    return keys, np.add.reduceat(n, first), pair & 0xFFFFFFFF, np.diff(first, append=len(code))


def build(corpus: DataFrame, path: str, key_bytes: int = KEY_BYTES, partitions: int | None = None) -> None:
    """Write the index, each file sorted by key, and a row about it.

    Keys are dealt over partitions, which follow the bytes of text, and are at least
    as many as the session's cores. ``key_bytes``: bytes of a needle that narrow a search.
    """
    spark = corpus.sparkSession
    about = corpus.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(n_bytes(F.col("text"))), F.lit(0)).alias("body_bytes"), F.coalesce(F.sum(F.length(F.coalesce("text", F.lit("")))), F.lit(0)).alias("suffixes")).first()
    partitions = partitions or planned_partitions(about["body_bytes"], spark.sparkContext.defaultParallelism)
    kind = to_arrow_type(corpus.schema["uid"].dataType)

    def run(batches):
        shard, texts, uids, size = TaskContext.get().partitionId() << 32, [], [], 0

        def made():
            keys, n, place, width = _postings(texts, uids)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(uids, kind).take(pa.array(place)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.full(len(keys), shard)), pa.array(n), lists], ["key", "shard", "n", "uids"])

        for batch in batches:
            for uid, text in zip(batch.column("uid"), pc.fill_null(batch.column("text"), "").cast(pa.binary())):
                if not (body := text.as_py()):
                    continue
                texts.append(body)
                uids.append(uid.as_py())
                size += len(body)
                if size >= SHARD_BYTES:
                    yield made()
                    shard, texts, uids, size = shard + 1, [], [], 0
        if texts:
            yield made()

    rows = search._spread(corpus.select("uid", "text")).mapInArrow(run, f"key binary, shard long, n long, uids array<{corpus.schema['uid'].dataType.simpleString()}>")
    placed = rows.repartition(partitions, "key").sortWithinPartitions("key", "shard")
    placed.write.mode("overwrite").option("parquet.block.size", 4 << 20).option("parquet.writer.version", "v2").option("compression", "zstd").parquet(path)
    row = (about["documents"], about["body_bytes"], about["suffixes"], key_bytes, partitions)
    spark.createDataFrame([row], "documents long, body_bytes long, suffixes long, key_bytes int, partitions int").coalesce(1).write.mode("overwrite").parquet(path.rstrip("/") + ".meta")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(documents, body_bytes, suffixes, key_bytes, partitions) of a written index, without reading it."""
    return spark.read.parquet(path.rstrip("/") + ".meta")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _in_range(low: bytes) -> F.Column:
    """Whether a key starts with ``low``, as a range that statistics narrow."""
    above = succ(low)
    return (F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(above)) if above else F.col("key") >= F.lit(low)


def probes(needle: bytes, key_bytes: int = KEY_BYTES) -> list[bytes]:
    """The keys that a document with the needle has: those within its first ``key_bytes``; the needle itself if it is no longer than a key."""
    if len(needle) <= GRAM:
        return [needle]
    most = max(min(len(needle), key_bytes), GRAM)
    return sorted({needle[i : i + GRAM] for i in range(most - GRAM + 1) if needle[i] & 0xC0 != 0x80})


def _with_keys(index: DataFrame, keys: list[bytes]) -> DataFrame:
    """Rows of these keys; a list that statistics can test reaches the scan."""
    if len(keys) <= KEY_BYTES * RANGES:
        return index.where(F.col("key").isin(keys))
    return index.join(F.broadcast(index.sparkSession.createDataFrame([(k,) for k in keys], "key binary")), "key", "left_semi")


def _rarest(index: DataFrame, asked: list[list[bytes]]) -> list[list[bytes]]:
    """The PROBES rarest keys of each list; lists with a key that no suffix has are left out, for their needle is nowhere."""
    keys = sorted({k for one in asked for k in one})
    if not keys:
        return []
    sizes = {bytes(r["key"]): r["n"] for r in _with_keys(index, keys).groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row for each key of a needle
    return [sorted(one, key=lambda k: (sizes[k], k))[:PROBES] for one in asked if all(k in sizes for k in one)]


def candidates(index: DataFrame, needles: list[bytes], key_bytes: int = KEY_BYTES) -> DataFrame:
    """(uid) of every document that may hold one of the needles; none that does is missing."""
    short = sorted({x for x in needles if len(x) <= GRAM})
    found = [index.where(F.lit(False)).select(F.explode("uids").alias("uid"))]
    for x in short:
        found.append(index.where(_in_range(x)).select(F.explode("uids").alias("uid")))
    chosen = _rarest(index, [probes(x, key_bytes) for x in sorted({x for x in needles if len(x) > GRAM})])
    if chosen:
        rows = index.sparkSession.createDataFrame([(i, len(keys), key) for i, keys in enumerate(chosen) for key in keys], "q int, m int, key binary")
        # one list for each probe, of the documents of one shard
        lists = _with_keys(index, sorted({k for keys in chosen for k in keys})).join(F.broadcast(rows), "key").groupBy("q", "m", "shard").agg(F.collect_list("uids").alias("u")).where(F.size("u") == F.col("m"))
        both = F.aggregate(F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(1))), F.get("u", 0), F.array_intersect)
        found.append(lists.select(F.explode(both).alias("uid")))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out.distinct()


def _held(index: DataFrame, needles: list[bytes], corpus: DataFrame, key_bytes: int) -> DataFrame:
    """The rows of the corpus that may hold one of the needles."""
    spark, path = index.sparkSession, fresh_path(index.sparkSession, "candidates")
    candidates(index, needles, key_bytes).select(F.col("uid").alias("__uid")).write.parquet(path)  # read more than once
    uids = spark.read.parquet(path)
    uids = F.broadcast(uids) if uids.count() <= BROADCAST_IDS else uids
    return corpus.select("uid", "text").join(uids, F.col("uid").eqNullSafe(F.col("__uid")), "left_semi")


def look_up(index: DataFrame, needle: str, corpus: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(uid, off) of every occurrence, found in the bodies that the index names."""
    if not needle:
        raise ValueError("an empty needle matches everywhere")
    asked = index.sparkSession.createDataFrame([(0, needle)], "query_id int, query string")
    return search.positions(_held(index, [needle.encode()], corpus, key_bytes), asked).select("uid", F.col("pos").alias("off"))


def count_of(index: DataFrame, needle: str, corpus: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(occurrences) of one needle; one no longer than a key is counted by the index alone."""
    if needle and len(needle.encode()) <= GRAM:
        return index.where(_in_range(needle.encode())).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
    return look_up(index, needle, corpus, key_bytes).agg(F.count(F.lit(1)).alias("occurrences"))


def key_ranges(keys: list[bytes], most: int = RANGES) -> list[tuple[bytes, bytes | None]]:
    """At most ``most`` ranges, low and the first beyond, that hold all that starts with any of the keys: neighbours are merged."""
    found = sorted((k, succ(k)) for k in set(keys))
    step = max(1, -(-len(found) // most))
    groups = [found[i : i + step] for i in range(0, len(found), step)]
    return [(g[0][0], None if any(hi is None for _, hi in g) else max(hi for _, hi in g)) for g in groups]


def look_up_all(index: DataFrame, needles: DataFrame, corpus: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(query_id, uid, off) of every occurrence of every needle, found in the bodies that the index names for any of them."""
    asked = needles.select("query_id", "query").where("query <> ''")
    raw = [r["query"].encode() for r in asked.select("query").distinct().collect()]  # a needle list, which is short by nature
    if not raw:
        return needles.select("query_id", F.lit(None).cast(corpus.schema["uid"].dataType).alias("uid"), F.lit(0).cast("long").alias("off")).limit(0)
    return search.positions(_held(index, raw, corpus, key_bytes), asked).select("query_id", "uid", F.col("pos").alias("off"))


def count_all(index: DataFrame, needles: DataFrame, corpus: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(query_id, query, occurrences) of every needle from the index; 0 where there is none."""
    found = look_up_all(index, needles, corpus, key_bytes).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return needles.join(found, "query_id", "left").select("query_id", "query", F.coalesce("n", F.lit(0)).cast("long").alias("occurrences"))


def retrieve_all(index: DataFrame, needles: DataFrame, corpus: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(query_id, query, doc_id, document) for every occurrence, from the index."""
    found = look_up_all(index, needles, corpus, key_bytes).join(needles, "query_id")
    return found.join(corpus, "uid").select("query_id", "query", F.col("uid").alias("doc_id"), F.col("text").alias("document"))


def full_suffixes(corpus: DataFrame) -> DataFrame:
    """(suffix, uid, off) with whole suffixes; for small corpora."""
    return suffixes(corpus, None)


def ranked(corpus: DataFrame) -> DataFrame:
    """(rank, uid, off, suffix) in full suffix order from 0: range-partitioned, sorted and numbered, with whole suffixes."""
    rows = number_rows(full_suffixes(corpus), ["key", "uid", "off"], "rank", 0)
    return rows.select("rank", "uid", F.col("off").cast("long").alias("off"), F.col("key").alias("suffix"))


def lcp(ranks: DataFrame) -> DataFrame:
    """(rank, lcp): bytes that each suffix shares with the one before; 0 for the first."""
    before = ranks.select((F.col("rank") + 1).alias("rank"), F.col("suffix").alias("before"))
    return ranks.join(before, "rank", "left").select("rank", common_prefix(F.col("suffix"), F.col("before")).alias("lcp"))


def validate(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rows, expected): an index counts a suffix for every code point of the corpus."""
    return index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).crossJoin(corpus.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("expected")))  # two single rows


#: Passes of ``long_matches`` over the keys of a large corpus, and bytes of text that a pass is worth in a small one.
PASSES, PASS_BYTES = 8, 8 << 20


#: Bytes of text that are hashed at once: its arrays stay in a core's cache.
HASHED = 128 << 10


def _words(buf: np.ndarray, n: int, width: int) -> np.ndarray:
    """The ``width`` (up to 8) bytes from each of the first ``n`` places as one number."""
    word, have = buf.astype(np.uint64), 1
    while have * 2 <= width:
        word, have = (word[:-have] << np.uint64(8 * have)) | word[have:], have * 2
    out = word[:n]
    for j in range(have, width):
        out = (out << np.uint64(8)) | buf[j : j + n]
    return out


def key_hashes(buf: np.ndarray, bounds: np.ndarray, key_bytes: int, passes: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every key of full length that starts at a code point and belongs to pass ``k``."""
    n = len(buf) - key_bytes + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    left = np.repeat(bounds[1:], np.diff(bounds))[:n] - np.arange(n)
    words = [_words(buf[i:], n, min(8, key_bytes - i)) for i in range(0, key_bytes, 8)]
    a = np.zeros(n, np.uint64)
    for word in words:
        a = _mixed(a ^ word)
    at = np.flatnonzero(((buf[:n] & 0xC0) != 0x80) & (left >= key_bytes) & (a % np.uint64(passes) == k))
    b = np.zeros(len(at), np.uint64)
    for word in words:
        b = _mixed(b + word[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return a[at] // np.uint64(passes), b


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_matches(corpus: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(groups, suffixes, largest): keys of full length that several suffixes share, and how many do.

    Keys are dealt by one hash over the passes and the parts of each, and counted
    there by another of 64 bits, sorted; one pass's keys are on disk at a time.
    """
    spark = corpus.sparkSession
    size = corpus.agg(F.coalesce(F.sum(n_bytes(F.col("text"))), F.lit(0))).first()[0]
    passes = max(1, min(PASSES, -(-size // PASS_BYTES)))
    parts = max(spark.sparkContext.defaultParallelism, -(-size // (passes * (2 << 20))))  # some 16 MB of hashes in each

    def dealt(batches, k):
        def hashed(texts):
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            return key_hashes(np.frombuffer(b"".join(texts), np.uint8), bounds, key_bytes, passes, k)

        def cut(found):
            part, b = (np.concatenate(x) for x in zip(*found))
            part = (part % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, b = part[order], b[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [x.tobytes() for x in np.split(b, first[1:])] if len(first) else []
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), pa.array(blobs, pa.binary())], ["part", "hashes"])

        held, size, found, total = [], 0, [], 0
        for batch in batches:
            for text in pc.fill_null(batch.column("text"), "").cast(pa.binary()):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= HASHED:
                    found.append(hashed(held))
                    held, size, total = [], 0, total + size
                if total >= 2 * SHARD_BYTES:
                    yield cut(found)
                    found, total = [], 0
        if held:
            found.append(hashed(held))
        if found:
            yield cut(found)

    def counted(table: pa.Table) -> pa.Table:
        h = np.sort(np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64))
        n = np.diff(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])))
        return pa.table({"groups": [int((n > 1).sum())], "suffixes": [int(n[n > 1].sum())], "largest": [int(n.max())]})

    done = []
    for k in range(passes):
        rows = search._spread(corpus.select("text")).mapInArrow(lambda batches, k=k: dealt(batches, k), "part long, hashes binary")
        each = rows.repartition(parts, "part").groupBy("part").applyInArrow(counted, "groups long, suffixes long, largest long")
        path = fresh_path(spark, "long-matches")  # a row for each part
        each.write.parquet(path)
        done.append(spark.read.parquet(path))
        del rows, each
        release(spark)
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out.agg(*(F.coalesce(f(c), F.lit(0)).cast("long").alias(c) for c, f in (("groups", F.sum), ("suffixes", F.sum), ("largest", F.max))))


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing reads any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
