"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, release


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) of every node of the links, root the smallest node it reaches.

    Alternates large-star and small-star steps, each one aggregation and one join
    on node ids, until nothing changes; the lineage is cut each time. Every step
    keeps the components and moves links to smaller nodes, so the work of a node
    with many links is summed before it is shuffled. More than ``most`` rounds raise
    an error, for their result could split components.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    before = edges.count()
    for _ in range(most):
        # large-star: each node's larger neighbours go to the smallest of the node and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: each node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, edges = edges, cut(small)
        after = edges.count()
        # both are sets of edges: as many as before, and none of them new
        same = after == before and edges.join(old, ["u", "v"], "left_anti").isEmpty()
        release(links.sparkSession, old)
        if same:
            break
        before = after
    else:
        raise RuntimeError(f"components did not converge in {most} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").union(stars.select(F.col("root").alias("node"), "root").distinct())
