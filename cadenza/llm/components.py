"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's least node) for every node but the roots; links has long columns a and b.

    Links are only ever rewired to smaller nodes, by minima (which combine before a shuffle) and joins with those
    minima (whose hot keys Spark splits); no node's neighbours are collected. It ends when every component is a star,
    after about as many rounds as the logarithm of the longest path. Each round is written to the shared folder.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(large.distinct())
        least = stage(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
        if edges.count() == least.count() and edges.join(least.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
