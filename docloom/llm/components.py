"""Connected components of an edge table by alternating large-star and small-star rounds, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: neighbours (the larger ones, or the smaller ones and the node itself) are linked to the smallest.

    The minimum of a node is a partial aggregate and comes back by a join, so that a node with very many edges can be split.
    """
    a, b = F.col("a"), F.col("b")
    sides = edges.unionByName(edges.select(b.alias("a"), a.alias("b"))) if large else edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = sides.join(least, "a")
    if large:
        out = joined.where(b > a).select(b.alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component): the smallest id reachable from each node that has an edge to another; rounds are logarithmic in practice."""
    state = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(limit):
        after = materialize(_star(_star(state, True), False), "edges")
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(state)
        state = after
        if tuple(found) == mark:
            break
        mark = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    # now every edge leads from a node to its component's smallest one
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
