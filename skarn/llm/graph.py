"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    side = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link down to a root, or is a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or down > 0 and up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node of edges(u, v): root is the smallest node of u's component.

    Each node's links are reduced by minima with map-side combining; hubs are joined as one row against their
    links, which adaptive execution can split.  Rounds grow with the logarithm of a component's size.
    """
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(edges):
        edges = cut(_small_star(_large_star(edges)))
    return edges.select("u", F.col("v").alias("root")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
