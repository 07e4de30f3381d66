"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a map-side summed minimum per node and one join, in which hubs are not shuffled by; the edges are written to the shared checkpoint
folder after each, so no step depends on an executor, and nothing but whether all is settled reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut

from .common import join_counted


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): links each v to the least node m among u and its neighbours."""
    least = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    joined = join_counted(pairs, least, "u", "n")
    if large:
        return joined.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    rest = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two roots, or is a root and has one: else all components are stars around their least node."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("below")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("below")))
    seen = ends.groupBy("u").agg(F.sum("below").alias("roots"), F.min("below").alias("low"))
    return bool(seen.where("roots > 1 or (roots = 1 and low = 0)").limit(1).count())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the component's least node."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if not _unsettled(edges):
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = cut(_star(both, True).distinct())
        edges = cut(_star(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
