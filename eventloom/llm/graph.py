"""Connected components by alternating large-star and small-star steps, each step a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved


def _unfinished(edges: DataFrame) -> bool:
    """Whether edges (a, b), a > b, aren't yet stars: some a has several b, or is a b too."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return bool(ends.where("up > 1 or up = 1 and n > 1").count())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of each end of the edges (a, b), the smallest node reachable. No edges, no rows.

    A star's centre may have any number of arms: least neighbours are sums of partial minima, and the joins back to the
    edges are plain equi-joins, which Spark splits where a key is hot. Nothing is collected but a count.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = saved(small.select("e.a", "e.b").where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
