"""Exact duplicates by a content sort, in DataFrame operations only.

Sampled splitters range-partition the rows on the first bytes of their normalised
text, its digest and a hash of the id; within a bucket an external sort in the
same order puts equal contents side by side, and each row is compared in full
with its neighbour. A bucket boundary may fall inside a run of copies, so a
content that a third of all rows share is spread over a third of the buckets; as
the orders agree, such a run is the first or last of each bucket, and these at
most two runs are stitched afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, documents, partitions

#: Rows sampled for each bucket, and hexadecimal digits of content ahead of the digest.
SAMPLES_PER_BUCKET, PREFIX_BYTES = 24, 12


def _head(text: Column) -> Column:
    return F.rpad(F.hex(F.substring(text.cast("binary"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")


def _sort_key(text: Column, sha: Column, tie: Column) -> Column:
    return F.concat(_head(text), sha, F.lpad(F.hex(tie), 16, "0"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "max",
    buckets: int | None = None,
) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts are the same bytes; a null text is
    empty. The row with the largest (``keep="max"``) or smallest id stays; null
    ids sort behind all others. Rows that repeat the id and the text of the row
    that stays have kept = true too, for they can't be told apart. An empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    n = rows.count()
    buckets = buckets or max(1, min(8 * partitions(spark), n // 64))
    keyed = rows.withColumn("sha", F.sha2(F.col("t").cast("binary"), 256)).withColumn("key", _sort_key(F.col("t"), F.col("sha"), F.xxhash64("id")))
    splitters = []
    if buckets > 1:
        wanted = buckets * SAMPLES_PER_BUCKET
        sampled = rows.sample(min(1.0, wanted / n), 17).withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))
        # bounded: about SAMPLES_PER_BUCKET strings of fixed length for each bucket
        sample = sorted(r[0] for r in sampled.select(_sort_key(F.col("t"), F.col("sha"), F.xxhash64("id"))).collect())
        splitters = [sample[i * len(sample) // buckets] for i in range(1, buckets)] if sample else []
    if splitters:
        table = F.split(F.lit(",".join(splitters)), ",")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))])
        # binary search: the number of splitters at or below the key
        bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(splitters)) & (F.get(table, at + s - 1) <= F.col("key")), at + s).otherwise(at))
    else:
        bucket = F.lit(0)
    placed = keyed.select("id", "t", "sha", _head(F.col("t")).alias("head"), bucket.alias("b"))

    best = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    # the order of the splitters: a run that crosses one is the first or last of its bucket
    order = Window.partitionBy("b").orderBy("head", "sha", "t", best)
    before = F.lag("t").over(order)
    runs = (
        placed.withColumn("new", F.when(before.isNull() | (before != F.col("t")), 1).otherwise(0))
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("id", "sha", "b", "run")
    )
    extreme = F.max if keep == "max" else F.min
    whole = Window.partitionBy("b")
    each = Window.partitionBy("b", "run")
    local = cut(
        runs.withColumn("keep", extreme("id").over(each))
        .withColumn("size", F.count(F.lit(1)).over(each))
        .withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(whole)))
    )
    # at most two rows for each bucket, whatever the input: small enough to broadcast
    stitched = local.where("edge").groupBy("b", "run", "sha").agg(F.max("keep").alias("keep"), F.max("size").alias("size")).groupBy("sha").agg(extreme("keep").alias("all_keep"), F.sum("size").alias("all_size"))
    joined = local.withColumn("edge_sha", F.when(F.col("edge"), F.col("sha"))).join(F.broadcast(stitched.withColumnRenamed("sha", "edge_sha")), "edge_sha", "left")
    keep_id = F.when(F.col("edge"), F.col("all_keep")).otherwise(F.col("keep"))
    return joined.select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.when(F.col("edge"), F.col("all_size")).otherwise(F.col("size")).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows alike in id and text, one.

    Rows meet the flags by one key of id and text, by which copies of a row then
    lie side by side already: whole rows are shuffled once.
    """
    key = lambda i, sha: F.concat(sha, F.coalesce(i.cast("string"), F.lit("null")))
    found = exact_duplicates(docs, id_col, text_col, keep=keep).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("__key")).distinct()
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"), 256)
    rows = docs.withColumn("__key", key(F.col(f"`{id_col}`"), sha))
    return rows.join(found, "__key", "left_semi").dropDuplicates(["__key"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
