"""Rank tests. Average ranks come from the counts of distinct values, so no window runs over all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certamap.functions.distributions import chi2_sf, normal_two_sided, t_two_sided
from certamap.operators.lineage import cut

#: Values of one range block of the running count.
BLOCK = 50_000


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(v, t, rank): every distinct non-null value, how often it is there, and its average rank.

    The running count goes over distinct values, in range blocks whose totals are summed apart.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("t"))
    n = cut(n)
    parts = max(1, n.count() // BLOCK)
    n = cut(n.repartitionByRange(parts, "v").withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    offsets = n.groupBy("_p").agg(F.sum("t").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).select(F.col("_p").alias("_q"), "_o")
    inside = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = n.withColumn("_c", F.sum("t").over(inside)).join(F.broadcast(offsets), F.col("_p") == F.col("_q"))
    return run.select("v", "t", (F.col("_c") + F.col("_o") - (F.col("t") - 1) / 2).alias("rank"))


def _tie_term(ranks: DataFrame) -> float:
    return ranks.agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t"))).first()[0] or 0.0


def kruskal_wallis(df: DataFrame, value: str, segment: str) -> DataFrame:
    """One row: h, p_value, significant, n_groups. Fewer than two groups give nulls and false."""
    spark = df.sparkSession
    used = df.where(F.col(value).isNotNull() & F.col(segment).isNotNull()).select(value, segment)
    used = used.select(F.col(value).alias("_x"), F.col(segment).alias("_k"))
    ranks = cut(value_ranks(used, "_x"))
    groups = used.join(ranks, F.col("_x") == F.col("v")).groupBy("_k").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    total, k, s = groups.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.col("r") * F.col("r") / F.col("n"))).first()
    schema = "h double, p_value double, significant boolean, n_groups long"
    if k < 2:
        return spark.createDataFrame([(None, None, False, k)], schema)
    ties = 1 - _tie_term(ranks) / (float(total) ** 3 - total)
    h = (12 / (total * (total + 1)) * s - 3 * (total + 1)) / ties if ties else float("nan")
    p = chi2_sf(h, k - 1)
    return spark.createDataFrame([(h, p, p < 0.05, k)], schema)


def mann_whitney(df: DataFrame, value: str, segment: str, a, b) -> DataFrame:
    """One row: u, p_value, effect_size_r, n_a, n_b, mean_a, mean_b; two-sided, tie- and continuity-corrected. Fewer than two values on a side give null statistics."""
    spark = df.sparkSession
    used = df.where(F.col(value).isNotNull() & F.col(segment).isin(a, b)).select(value, segment)
    used = used.select(F.col(value).alias("_x"), F.col(segment).alias("_k"))
    ranks = cut(value_ranks(used, "_x"))
    got = {r[0]: r for r in used.join(ranks, F.col("_x") == F.col("v")).groupBy("_k").agg(F.sum("rank"), F.count(F.lit(1)), F.avg("_x")).collect()}
    ra, na, ma = (got[a][1], got[a][2], got[a][3]) if a in got else (0.0, 0, None)
    nb, mb = (got[b][2], got[b][3]) if b in got else (0, None)
    schema = "u double, p_value double, effect_size_r double, n_a long, n_b long, mean_a double, mean_b double"
    if na < 2 or nb < 2:
        return spark.createDataFrame([(None, None, None, na, nb, ma, mb)], schema)
    n, u = na + nb, ra - na * (na + 1) / 2
    sd = math.sqrt(na * nb / 12 * ((n + 1) - _tie_term(ranks) / (n * (n - 1))))
    z = max(0.0, (max(u, na * nb - u) - na * nb / 2 - 0.5) / sd) if sd else 0.0
    return spark.createDataFrame([(float(u), min(1.0, normal_two_sided(z)), z / math.sqrt(n), na, nb, ma, mb)], schema)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rho, p_value, n, over complete pairs; fewer than three give nulls."""
    spark = df.sparkSession
    used = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    ra = value_ranks(used, "_a").select(F.col("v").alias("_va"), F.col("rank").alias("_ra"))
    rb = value_ranks(used, "_b").select(F.col("v").alias("_vb"), F.col("rank").alias("_rb"))
    rho, n = used.join(ra, F.col("_a") == F.col("_va")).join(rb, F.col("_b") == F.col("_vb")).agg(F.corr("_ra", "_rb"), F.count(F.lit(1))).first()
    schema = "rho double, p_value double, n long"
    if n < 3 or rho is None or math.isnan(rho):
        return spark.createDataFrame([(None, None, n)], schema)
    p = 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
    return spark.createDataFrame([(rho, p, n)], schema)
