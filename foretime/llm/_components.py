"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node gets an edge to the node's smallest neighbour (or the node itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "component-least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it get edges to the smallest of them."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "component-least")
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _sum_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable), for every id on an edge (a, b) of distinct ids.

    Each step is an aggregation that combines before its shuffle, written to the shared folder, and
    a join of two tables, whose skewed partitions Spark may split; its edges are written too.
    The number of steps grows with the logarithm of the longest path.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "component-edges")
    before = _sum_of(edges)
    while True:
        edges = materialise(_small_star(_large_star(edges)).distinct(), "component-edges")
        after = _sum_of(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
