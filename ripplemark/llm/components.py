"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the least node of its component.

    Each step is a window minimum over a node's neighbours, so a hub's list is streamed, never collected.
    The edges of each round are written to the shared folder. Self-loops, repeated edges and nulls are
    left out; an empty table gives an empty result. The rounds grow with the logarithm of the longest path.
    """
    by_u = Window.partitionBy("u")
    least = F.least(F.col("u"), F.min("v").over(by_u))
    stars = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # After the large step every edge points down (v < u): the small step ties a node's smaller neighbours to the least.
        small = large.select("u", "v", F.min("v").over(by_u).alias("m"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, stars = stars, materialize(small, "edges")
        discard(old)  # written anew, so nothing reads it any longer
        # An unchanged set of edges (by count and sum of hashes) is a forest of stars.
        after = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
