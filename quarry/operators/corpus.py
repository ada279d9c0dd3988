"""Offsets, validity and statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import n_bytes, valid_body
from quarry.sources import id_ranges

#: Bytes of a document's tag in a flat corpus.
TAG_BYTES = 6


def doc_offsets(corpus: DataFrame) -> DataFrame:
    """(uid, start_pos, end_pos, n_bytes): where each tagged document lies in the flat corpus.

    Running sums in two passes: within ranges of uid, which are quantiles as many as
    the rows ask for, and over the ranges' totals, so that no task sees all rows.
    """
    sizes = corpus.select("uid", n_bytes(F.col("text")).alias("n_bytes"))
    placed = sizes.withColumn("b", id_ranges(sizes, "uid"))
    totals = placed.groupBy("b").agg(F.sum(F.col("n_bytes") + TAG_BYTES).alias("t"))
    bases = totals.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")  # a row for each range
    within = Window.partitionBy("b").orderBy("uid").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("run", F.sum(F.col("n_bytes") + TAG_BYTES).over(within)).join(F.broadcast(bases), "b")
    end = F.col("base") + F.col("run")
    return ends.select("uid", (end - F.col("n_bytes") - TAG_BYTES).alias("start_pos"), end.alias("end_pos"), "n_bytes")


def locate(offsets: DataFrame, points: DataFrame, cell: int = 1 << 16) -> DataFrame:
    """(pos, uid) of the document that holds each global position: an equi-join on cells, then the range."""
    cells = F.sequence(F.floor(F.col("start_pos") / cell), F.floor((F.col("end_pos") - 1) / cell))
    spread = offsets.withColumn("cell", F.explode(cells))
    rows = points.withColumn("cell", F.floor(F.col("pos") / cell)).join(spread, "cell")
    return rows.where("pos >= start_pos AND pos < end_pos").select("pos", "uid")


def statistics(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Documents, bytes of bodies and of the flat corpus, valid documents, mean, deviation, least and most bytes."""
    rows = corpus.select(*(by or []), n_bytes(F.col("text")).alias("n"), valid_body(F.col("text")).alias("ok"))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("body_bytes"),
        F.coalesce(F.sum(F.col("n") + TAG_BYTES), F.lit(0)).cast("long").alias("corpus_bytes"),
        F.count_if("ok").alias("valid_docs"),
        F.round(F.avg("n"), 4).alias("mean_bytes"),
        F.round(F.stddev_pop("n"), 4).alias("std_bytes"),
        F.min("n").alias("min_bytes"),
        F.max("n").alias("max_bytes"),
    )


def invalid_documents(corpus: DataFrame) -> DataFrame:
    return corpus.where(~valid_body(F.col("text")))
