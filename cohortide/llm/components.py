"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortide.llm.scratch import clear, keep


def _stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has just one, which has none itself."""
    parents = edges.select(F.col("v").alias("u"), F.lit(0).alias("k"), F.lit(1).alias("above"))
    nodes = edges.select("u", F.lit(1).alias("k"), F.lit(0).alias("above")).union(parents)
    nodes = nodes.groupBy("u").agg(F.sum("k").alias("k"), F.max("above").alias("above"))
    return nodes.filter((F.col("k") > 1) | ((F.col("k") > 0) & (F.col("above") > 0))).isEmpty()


def connected_components(edges: DataFrame, shelf: list[str] | None = None) -> DataFrame:
    """(node, label) of every node with an edge (u, v) to another; the label is the smallest node reachable.

    In turn each node hands its larger neighbours, then its smaller ones, to the smallest node it
    knows; the number of rounds grows with the logarithm of the longest path.  Minima are
    combined before they are shuffled and joined back from a written table, so a node with a third
    of all edges is split like any skewed join.
    """
    spark, own = edges.sparkSession, []
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges = keep(ordered, "edges", own)
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", own)
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large", own)
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least", own)
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", own)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    labels = keep(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots), "labels", shelf)
    clear(spark, own)
    return labels
