"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certamap.operators.lineage import cut

#: Rows that a block of `blocked_prefix` aims at, and the most blocks a group is cut into.
BLOCK_ROWS, MOST_BLOCKS = 256, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores after it as make it a column that `df` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """How many runs of characters other than white space (code points 9 to 13 and 32) a text has; 0 for null. Each run becomes one character, so no list of words is built."""
    marked = F.regexp_replace(F.concat(F.lit("x "), text), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.char_length(marked) - 1, F.lit(0)).cast("long")


def blocks_for(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, min(MOST_BLOCKS, math.ceil(rows / block_rows)))


def blocked_prefix(df: DataFrame, group: str, place: str, ties: list[str], value: str, out: str, rows: int, slim: DataFrame | None = None) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same `group` that come before, in the order of `place` and `ties`.

    `place` is a long that is uniform over all 64 bits. A group is cut into ranges of it, so no task
    holds a whole group: block totals give each block's offset, and a window runs inside a block only.
    `slim` has the same rows as `df` with `group`, `place` and `value` alone, where those are at hand.
    """
    n = blocks_for(rows)
    block = F.least(F.lit(n - 1), F.floor((F.col(place).cast("double") / F.lit(2.0**64) + 0.5) * n)).cast("int")
    df = df.withColumn("_block", block)
    totals = (df if slim is None else slim.withColumn("_block", block)).groupBy(group, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(totals.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), "_sum").withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long")).drop("_sum"))
    inside = Window.partitionBy(group, "_block").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    joined = df.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")), "left")
    return joined.withColumn(out, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset", "_block", "_g", "_b")
