"""Grouped summaries of certainty and error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certamap.functions.dictionaries import CATEGORIES
from certamap.operators.lineage import cut

#: Distinct values of one range block of a running count.
BLOCK = 50_000


def rmse(d: Column) -> Column:
    return F.sqrt(F.avg(d * d))


def quantiles(df: DataFrame, key: str | None, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, one column for each of `wanted`): interpolated quantiles {name: (column, probability)} within each non-null key, or of all rows in one row.

    They are read off the running counts of distinct values, which go over range blocks whose totals are summed apart: no task holds the
    values of a group. Nulls do not count; a group without values has none of its quantiles.
    """
    used = df.where(F.col(key).isNotNull()).withColumn("_k", F.col(key)) if key else df.withColumn("_k", F.lit(0))
    columns = sorted({c for c, _ in wanted.values()})
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]))
    counts = used.select("_k", each).where("_v is not null").groupBy("_k", "_c", "_v").agg(F.count(F.lit(1)).alias("_t"))
    counts = cut(counts)
    parts = counts.count() // BLOCK
    counts = cut(counts.repartitionByRange(parts, "_k", "_c", "_v").withColumn("_p", F.spark_partition_id())) if parts > 1 else counts.withColumn("_p", F.lit(0))
    totals = counts.groupBy("_k", "_c", "_p").agg(F.sum("_t").alias("_s"))  # a row for each block of a group
    own = Window.partitionBy("_k", "_c")
    before = F.coalesce(F.sum("_s").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_k", "_c", "_p", before.alias("_o"), F.sum("_s").over(own).alias("_n"))
    inside = Window.partitionBy("_k", "_c", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_i", F.sum("_t").over(inside)).join(offsets, ["_k", "_c", "_p"]).withColumn("_i", F.col("_i") + F.col("_o"))
    out = []
    for name, (c, p) in wanted.items():
        place = F.lit(p) * (F.col("_n") - 1)
        at = lambda k: F.max(F.when((F.col("_c") == c) & (k >= F.col("_i") - F.col("_t")) & (k < F.col("_i")), F.col("_v")))  # noqa: E731, B023
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(F.when(F.col("_c") == c, place - F.floor(place)))
        out.append((low + part * (high - low)).alias(name))
    got = run.groupBy("_k").agg(*out)
    return got.withColumnRenamed("_k", key) if key else got.drop("_k")


def mae(d: Column) -> Column:
    return F.avg(F.abs(d))


def metrics_by_segment(df: DataFrame, segment: Column | str, distance: str = "match_distance", match_rate: bool = False) -> DataFrame:
    """Twelve columns a segment, largest first: segmento, n, pct, means of the scores, GCI median and deviation, RMSE, CE90, MAE.

    pct is of all rows, those without a segment included; they make no row. Scores that `df` lacks are null.
    """
    key = F.col(segment) if isinstance(segment, str) else segment
    have = {c.lower(): c for c in df.columns}
    col = lambda c: F.col(have[c]) if c in have else F.lit(None).cast("double")
    d = col(distance.lower())
    aggs = [
        F.count(F.lit(1)).alias("n"),
        *(F.avg(col(c)).alias(f"{c}_mean") for c in ("lci", "mci", "pci", "gci")),
        F.stddev_samp(col("gci")).alias("gci_std"),
        rmse(d).alias("rmse"),
        mae(d).alias("mae"),
        *([F.avg(d.isNotNull().cast("int")).alias("match_rate")] if match_rate else []),
    ]
    keyed = df.withColumn("segmento", key)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row a segment
    groups = keyed.groupBy("segmento").agg(*aggs).withColumn("pct", F.try_divide(F.col("n") * 100.0, total.cast("double"))).where("segmento is not null")
    middle = quantiles(keyed.select("segmento", col("gci").alias("_g"), d.alias("_d")), "segmento", {"gci_median": ("_g", 0.5), "ce90": ("_d", 0.9)})
    out = groups.join(middle, "segmento", "left")
    shares = ["match_rate"] if match_rate else []
    return out.select("segmento", "n", "pct", "lci_mean", "mci_mean", "pci_mean", "gci_mean", "gci_median", "gci_std", "rmse", "ce90", "mae", *shares).orderBy(F.desc("n"), "segmento")


def value_counts(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)
    return out.limit(top) if top else out


def crosstab_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, share): shares within a row; rows with a null on either side are left out."""
    n = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return n.select(row, col, (F.col("n") / F.sum("n").over(Window.partitionBy(row))).alias("share"))


def confusion(df: DataFrame, row: str, col: str, labels: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(row_label, col_label, n, pct): the full matrix of the labels, zeros included; other labels are left out. A row without counts has null pct."""
    spark = df.sparkSession
    n = df.where(F.col(row).isin(*labels) & F.col(col).isin(*labels)).groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "row_label string, col_label string")
    full = grid.join(n, (F.col("row_label") == F.col("r")) & (F.col("col_label") == F.col("c")), "left").select("row_label", "col_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.withColumn("pct", F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy("row_label")).cast("double")))


def agreement(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.try_divide(100.0 * F.sum(F.when(F.col("row_label") == F.col("col_label"), F.col("n")).otherwise(0)), F.sum("n").cast("double")).alias("agreement"))


def entropy_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, entropy): bits of a five-bin histogram over [0, 1]; the last bin is closed, values outside are ignored."""
    v = F.col(value)
    b = F.when(v.between(0, 1), F.least(F.when(v >= 0.8, 4).when(v >= 0.6, 3).when(v >= 0.4, 2).when(v >= 0.2, 1).otherwise(0), F.lit(4)))
    n = df.where(F.col(key).isNotNull()).withColumn("_b", b).where("_b is not null").groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    p = n.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(key)))
    return p.groupBy(key).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def nullity(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_null, present_pct)."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fields], F.count(F.lit(1)).alias("_n"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_null")) for c in fields])).alias("r")
    return one.select(rows, "_n").select("r.*", F.try_divide(100.0 * (F.col("_n") - F.col("r.n_null")), F.col("_n").cast("double")).alias("present_pct"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles of a value by group, and the whiskers: the extremes within 1.5 interquartile ranges of the box."""
    df = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)
    q = quantiles(df, key, {"q1": (value, 0.25), "q2": (value, 0.5), "q3": (value, 0.75)}).join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key).withColumnRenamed(key, "_k")
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, F.col(key) == F.col("_k")).where(F.col(value).between(low, high))
    return inside.groupBy(key, "n", "q1", "q2", "q3").agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))


def violin(df: DataFrame, key: str, value: str, top: int = 10, steps: int = 20, bins: int = 500) -> DataFrame:
    """(key, step, place, density): a Gaussian kernel density of the value in the `top` largest groups, from its least to its greatest value.

    The bandwidth is the deviation times n to the power -1/5. Values count at the middles of bins of width 1 / `bins`, so what is summed is bounded by bins, not rows.
    """
    largest = value_counts(df, key, top).select(F.col(key).alias("_t"))
    used = df.where(F.col(value).isNotNull()).join(largest, F.col(key) == F.col("_t"), "left_semi")
    cells = used.groupBy(F.col(key).alias("_g"), ((F.floor(F.col(value) * bins) + 0.5) / bins).alias("v")).agg(F.count(F.lit(1)).alias("t"))
    shape = used.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), (F.stddev_samp(value) * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h")).where("h > 0")
    grid = shape.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("place", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / float(steps))
    off = F.col("place") - F.col("v")
    each = grid.join(cells, F.col(key) == F.col("_g")).withColumn("_k", F.col("t") * F.exp(-off * off / (2 * F.col("h") * F.col("h"))))
    return each.groupBy(key, "step", "place", "n", "h").agg(F.sum("_k").alias("_s")).select(key, "step", "place", (F.col("_s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_n(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """Exactly n rows (all, if fewer), the same on every run: those whose id and seed hash lowest."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), id_col).limit(n)


def resolve_column(df: DataFrame, patterns: list[str], exclude: tuple[str, ...] = (), numeric: bool = False) -> str | None:
    """The first column whose name contains one of the patterns; else the first that is not excluded (and is numeric, if asked)."""
    for p in patterns:
        for c in df.columns:
            if p.lower() in c.lower():
                return c
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    return next((c for c, k in df.dtypes if c not in exclude and (not numeric or k.startswith(kinds))), None)
