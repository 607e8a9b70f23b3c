"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node among it and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of those. Every u here is larger than its v."""
    least = written(e.groupBy("u").agg(F.min("v").alias("m")))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _stars(e: DataFrame) -> bool:
    """Does each node point to one that points nowhere? Then nothing can move any more."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return not ends.where("out > 1 OR out > 0 AND into > 0").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v long. Returns node, component (the least node reachable) for each node with an edge.

    No group is gathered: a node's least neighbour is a pre-aggregated minimum, written and joined back, so that Spark can
    split a node with many links like any skewed join key. Each round is written to the shared folder.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(e):
        e = written(_small(_large(e)).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
