"""Connected components of edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.storage import freed, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component: the least node reachable. Edges of a node with itself count for nothing.

    Alternating large-star and small-star steps: each joins edges with the least neighbour of their node. Both sides of these joins are
    written tables, so that adaptive execution may divide the edges of a hub among tasks.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        small = saved(large.join(low, "u").select(ends).select("e.u", "e.v").where("u <> v").distinct(), "edges")
        freed(now, least, large, low)
        now = small
    found = saved(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    freed(now)
    return found


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down or some up, so that the lower end of each edge is its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()
