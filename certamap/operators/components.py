"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certamap.operators.lineage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).withColumnRenamed("a", "n"))
    return both.join(low, both.a == low.n).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = cut(down.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n"))
    near = down.join(low, down.a == low.n).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return near.union(low.select(F.col("n").alias("a"), F.col("low").alias("b")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge that joins two different nodes; root is the smallest node of its component.

    The rounds grow with the logarithm of the longest path; each ends in a table in the shared folder.
    A node's edges are never gathered in a list, and the joins are plain ones whose large partitions Spark splits.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct()).distinct()
        seen = mark
        now = cut(_small_star(cut(_large_star(now).distinct())).distinct())
