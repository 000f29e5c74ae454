"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, spread_join


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node u to the smaller v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return spread_join(both, low, ["u"], F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(edges, low, ["u"], F.col("v")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _flat(edges: DataFrame) -> bool:
    """Whether every edge leads to the smallest node of its component: no node has two edges down, or one down and one from above."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 0 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of long node ids to (node, component): the smallest node of its component, for each node that has an edge."""
    edges = materialize(_down(edges), "edges")
    while not _flat(edges):
        edges = materialize(_down(_small_star(_down(_large_star(edges)))), "edges")
    # Now every edge leads from a node to the smallest of its component.
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
