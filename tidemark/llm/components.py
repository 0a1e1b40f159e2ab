"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours; a table of its own, so that a hub's rows can be split in the join."""
    return cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours are moved to the smallest one; a link may come twice."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are moved to the smallest one."""
    moved = edges.join(_least(edges), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two links up, and none has links both up and down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(u long, v long)``; component is its smallest reachable node.

    Each round is an aggregate with map-side partial minima and a join whose large keys can be split; rounds grow with
    the logarithm of the diameter and end when all links are stars about their smallest node. No edges give no rows;
    self-links and repeats add nothing.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(now):
        now = cut(_small_star(cut(_large_star(now))))
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
