"""Recursive closures by frontier, and bounded chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def reachable(edges: DataFrame, roots: DataFrame, limit: int = 1000) -> DataFrame:
    """``(node, depth)`` for every node that ``edges(src, dst)`` lead to from ``roots(node)``; roots have depth 0.

    Breadth first: each round joins only the newest nodes with the edges and drops the ones seen before, so cycles
    end. Rounds are written to the shared folder. ``limit`` bounds the depth of a broken graph; reaching it is an error.
    """
    edges = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "links")
    seen = frontier = materialize(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "reached")
    for depth in range(1, limit + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"the closure is deeper than {limit}")


def bounded_chain(items: DataFrame, key: str, parent: str, accepted: str, limit: int) -> DataFrame:
    """``(key, found, depth, outcome)``: follow ``parent`` from each item to the first accepted one.

    The outcome is ``found``, ``cycle`` (the chain came back to its start or to itself), ``broken`` (a null or unknown
    parent) or ``too deep`` (over ``limit`` steps). Only chains that go on are joined with the next items; settled ones are set aside, each round
    is written to the shared folder, and the rounds end with the last open chain.
    """
    table = items.select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(accepted).alias("ok"))
    settled = F.when(F.col("ok"), "found").when(F.col("p").isNull(), "broken").when(F.array_contains("path", F.col("p")), "cycle")
    nxt = table.select(F.col("k").alias("nk"), F.col("p").alias("np"), F.col("ok").alias("nok"))
    state = table.select(F.col("k").alias("start"), F.col("k").alias("at"), "p", "ok", F.array("k").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("outcome"))
    done = None
    for depth in range(limit + 1):
        state = materialize(state.withColumn("outcome", F.coalesce("outcome", settled)), "chains")
        here = state.where("outcome is not null" if depth < limit else "true").select("start", "at", "depth", F.coalesce("outcome", F.lit("too deep")).alias("outcome"))
        done = here if done is None else done.unionByName(here)
        if depth == limit or (state := state.where("outcome is null")).isEmpty():
            break
        step = state.join(nxt, F.col("p") == F.col("nk"), "left")
        there = F.col("nk").isNotNull()
        state = step.select(
            "start", F.coalesce("nk", "at").alias("at"), F.col("np").alias("p"), F.coalesce("nok", F.lit(False)).alias("ok"), F.when(there, F.concat("path", F.array("nk"))).otherwise(F.col("path")).alias("path"),
            F.when(there, depth + 1).otherwise(F.col("depth")).alias("depth"), F.when(~there, "broken").alias("outcome"),
        )
    return done.select(F.col("start").alias(key), F.when(F.col("outcome") == "found", F.col("at")).alias("found"), "depth", "outcome")
