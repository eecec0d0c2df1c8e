"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum and an equi-join, so a hub is one key of a join that AQE splits, never one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` go from larger to smaller; the smaller neighbours of a node, and itself, are linked to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges`` is (u, v), the component its smallest node.

    Self-loops and repeated edges are ignored.  Ends when a round changes nothing: the edges then are stars around the minima.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    marks = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = marks(now)
    for _ in range(MAX_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        after = marks(now)
        if after == before:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
        before = after
    raise RuntimeError("components did not settle")
