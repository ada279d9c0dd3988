"""Search over documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.search import hit_counts


def count_stream(stream: DataFrame, needles: DataFrame) -> DataFrame:
    """Running occurrences (query_id, query, occurrences) of each needle found in a stream of (uid, text).

    Write it in update or complete mode; the state is one row for each needle.
    """
    found = hit_counts(stream, needles).join(needles.select("query_id", "query"), "query_id")
    return found.groupBy("query_id", "query").agg(F.sum("n").alias("occurrences"))
