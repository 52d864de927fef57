"""Density clusters, variogram, inequality and directions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certamap.operators.components import components
from certamap.operators.lineage import cut
from certamap.operators.ranks import value_ranks
from certamap.operators.spatial_joins import pairs_within


def dbscan(points: DataFrame, eps: float, least: int, id_col: str = "addr_id") -> DataFrame:
    """(id, cluster, core): cluster is the smallest core id of the cluster, -1 for noise. A point counts among its neighbours; a border point goes to the smallest cluster that reaches it."""
    sites = cut(points.groupBy("x", "y").agg(F.min(id_col).alias("site"), F.count(F.lit(1)).alias("n")))  # equal points are one, however many
    near = cut(pairs_within(sites, eps, "site", ("n",)).select("i", "j", "a_n", "b_n"))
    both = near.select("i", "j", "b_n").union(near.select("j", "i", "a_n"))
    around = both.groupBy("i").agg(F.sum("b_n").alias("m"))
    core = cut(sites.join(around, F.col("site") == F.col("i"), "left").where(F.col("n") + F.coalesce("m", F.lit(0)) >= least).select(F.col("site").alias("c")))
    a, b = core.withColumnRenamed("c", "ca"), core.withColumnRenamed("c", "cb")
    links = near.join(a, F.col("i") == F.col("ca")).join(b, F.col("j") == F.col("cb")).select("i", "j")
    root = cut(core.join(components(links, "i", "j"), F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root")))
    reached = both.join(root, F.col("j") == F.col("c")).groupBy("i").agg(F.min("root").alias("border"))
    named = sites.join(root, F.col("site") == F.col("c"), "left").join(reached, F.col("site") == F.col("i"), "left")
    named = named.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.coalesce("root", "border", F.lit(-1)).alias("cluster"), F.col("c").isNotNull().alias("core"))
    out = points.select(F.col(id_col).alias("id"), "x", "y").join(named, F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y")))
    return out.select("id", "cluster", "core")


def cluster_summary(points: DataFrame, clusters: DataFrame, value: str, id_col: str = "addr_id", top: int = 10) -> DataFrame:
    met = points.join(clusters.where("cluster >= 0"), F.col(id_col) == F.col("id"))
    return met.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(value).alias("mean")).orderBy("cluster").limit(top)


def semivariogram(points: DataFrame, value: str, lag: float, lags: int, id_col: str = "addr_id") -> DataFrame:
    """(lag_bin, n, gamma): half the mean squared difference of pairs, by distance."""
    pairs = pairs_within(points.where(F.col(value).isNotNull()), lag * lags, id_col, (value,))
    d = F.sqrt("d2")
    diff = F.col(f"a_{value}") - F.col(f"b_{value}")
    binned = pairs.select(F.floor(d / lag).cast("int").alias("lag_bin"), (diff * diff).alias("s")).where(F.col("lag_bin") < lags)
    return binned.groupBy("lag_bin").agg(F.count(F.lit(1)).alias("n"), (F.avg("s") / 2).alias("gamma"))


def spherical_fit(variogram: DataFrame, lag: float) -> DataFrame:
    """One row: range, sill, nugget, by weighted least squares over the bins; nugget and partial sill are linear for a given range."""
    rows = [(r["lag_bin"] * lag + lag / 2, r["gamma"], r["n"]) for r in variogram.collect()]  # one a lag bin

    def best(reach: float) -> tuple[float, float, float]:
        x = [1.5 * h / reach - 0.5 * (h / reach) ** 3 if h <= reach else 1.0 for h, *_ in rows]
        w = [n for *_, n in rows]
        sw, sx, sy = sum(w), sum(a * b for a, b in zip(w, x, strict=True)), sum(n * g for _, g, n in rows)
        sxx, sxy = sum(a * b * b for a, b in zip(w, x, strict=True)), sum(n * g * b for (_, g, n), b in zip(rows, x, strict=True))
        det = sw * sxx - sx * sx
        c = max(0.0, (sw * sxy - sx * sy) / det) if det > 1e-12 else 0.0
        b = max(0.0, (sy - c * sx) / sw)
        return sum(n * (g - b - c * v) ** 2 for (_, g, n), v in zip(rows, x, strict=True)), b, c

    spark = variogram.sparkSession
    schema = "range double, sill double, nugget double"
    if not rows:
        return spark.createDataFrame([(None, None, None)], schema)
    top = max(h for h, *_ in rows)
    _, reach = min((round(best(top * k / 200)[0], 6), top * k / 200) for k in range(1, 241))  # of equally good ranges the shortest
    _, b, c = best(reach)
    return spark.createDataFrame([(reach, b + c, b)], schema)


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: n, gini. Average ranks of distinct values stand for the order, so ties and size do not matter."""
    ranks = value_ranks(df, value)
    n, s, rs = ranks.agg(F.sum("t"), F.sum(F.col("t") * F.col("v")), F.sum(F.col("t") * F.col("rank") * F.col("v"))).first()
    g = 2 * rs / (n * s) - (n + 1) / n if n and s else None
    return df.sparkSession.createDataFrame([(n or 0, g)], "n long, gini double")


def lorenz(df: DataFrame, value: str, points: int = 10) -> DataFrame:
    """(step, share_of_rows, share_of_value) at every tenth of the rows, in ascending order of the value; values that straddle a step count in part."""
    ranks = cut(value_ranks(df, value))
    n, s = ranks.agg(F.sum("t"), F.sum(F.col("t") * F.col("v"))).first()
    if not n or not s:
        return df.sparkSession.createDataFrame([], "step int, share_of_rows double, share_of_value double")
    first = F.col("rank") - (F.col("t") + 1) / 2.0
    grid = F.explode(F.sequence(F.lit(1), F.lit(points))).alias("step")
    inside = F.greatest(F.lit(0.0), F.least(F.col("t").cast("double"), F.col("step") * F.lit(n / points) - first))
    return ranks.select("*", grid).groupBy("step").agg((F.sum(inside * F.col("v")) / F.lit(float(s))).alias("share_of_value")).select("step", (F.col("step") / F.lit(float(points))).alias("share_of_rows"), "share_of_value")


def maup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(scale, n_areas, mean_of_means, cv): how area means vary with the choice of areas."""
    spark, out = df.sparkSession, None
    for k in keys:
        means = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.avg(value).alias("m"))
        part = means.agg(F.count("m").alias("n_areas"), F.avg("m").alias("mean_of_means"), F.try_divide(F.stddev_samp("m"), F.avg("m")).alias("cv")).select(F.lit(k).alias("scale"), "*")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "scale string, n_areas long, mean_of_means double, cv double")


def spider_lines(df: DataFrame, value: str, n: int = 1000, seed: int = 42, id_col: str = "addr_id") -> DataFrame:
    """Displacements of a seeded sample: (id, x, y, gx, gy, len, azimuth, metric). Rows without both points make no line; the metric is 0.5 where there is no such column."""
    from certamap.operators.segments import sample_n

    whole = df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("gx").isNotNull() & F.col("gy").isNotNull())
    dx, dy = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
    metric = F.col(value) if value in df.columns else F.lit(0.5)
    return sample_n(whole, n, seed, id_col).select(id_col, "x", "y", "gx", "gy", F.sqrt(dx * dx + dy * dy).alias("len"), F.atan2(dx, dy).alias("azimuth"), metric.alias("metric"))


def rayleigh(df: DataFrame) -> DataFrame:
    """One row: n, mean_direction, r_bar, z, p_value, over the directions of non-zero displacements."""
    dx, dy = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
    size = F.sqrt(dx * dx + dy * dy)
    n, c, s = df.where(size > 0).agg(F.count(F.lit(1)), F.sum(dy / size), F.sum(dx / size)).first()
    schema = "n long, mean_direction double, r_bar double, z double, p_value double"
    if not n:
        return df.sparkSession.createDataFrame([(0, None, None, None, None)], schema)
    r = math.hypot(c, s)
    p = math.exp(math.sqrt(1 + 4 * n + 4 * (n * n - r * r)) - (1 + 2 * n))
    return df.sparkSession.createDataFrame([(n, math.atan2(s, c), r / n, r * r / n, min(1.0, p))], schema)


def bootstrap(df: DataFrame, value: str, id_col: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """One row: mean, ci_low, ci_high. Every row has, in every replicate, a Poisson(1) weight read off a hash of its id, so there is one pass and no resampling."""
    steps = [math.exp(-1) * sum(1 / math.factorial(k) for k in range(m + 1)) for m in range(8)]
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    rows = df.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).alias("v"), rep)
    u = F.conv(F.substr(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("rep").cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(2.0**32)
    w = sum(F.when(F.col("u") >= s, 1).otherwise(0) for s in steps)
    means = rows.withColumn("u", u).withColumn("w", w).groupBy("rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit((1 - level) / 2)).alias("ci_low"), F.percentile("m", F.lit((1 + level) / 2)).alias("ci_high"))


def density_grid(points: DataFrame, side: float, bandwidth: float, id_col: str = "addr_id") -> DataFrame:
    """(ci, cj, n, density): counts in square cells, and the sum of a quartic kernel over the counts of cells within the bandwidth."""
    cells = cut(points.groupBy(F.floor(F.col("x") / side).alias("ci"), F.floor(F.col("y") / side).alias("cj")).agg(F.count(F.lit(1)).alias("n")))
    reach = math.ceil(bandwidth / side)
    around = F.sequence(F.lit(-reach), F.lit(reach))
    spread = cells.select("n", "ci", "cj", F.explode(around).alias("di")).select("*", F.explode(around).alias("dj"))
    u2 = (F.col("di") ** 2 + F.col("dj") ** 2) * (side / bandwidth) ** 2
    spread = spread.where(u2 < 1).select((F.col("ci") + F.col("di")).alias("ti"), (F.col("cj") + F.col("dj")).alias("tj"), (F.col("n") * (1 - u2) ** 2 * 3 / (math.pi * bandwidth**2)).alias("k"))
    summed = spread.groupBy("ti", "tj").agg(F.sum("k").alias("density"))
    return cells.join(summed, (F.col("ci") == F.col("ti")) & (F.col("cj") == F.col("tj"))).select("ci", "cj", "n", "density")


def qq(df: DataFrame, value: str, points: int = 19) -> DataFrame:
    """(p, sample, normal): quantiles of a value beside those of a normal distribution of its mean and deviation."""
    from certamap.functions.distributions import normal_ppf
    from certamap.operators.segments import quantiles

    ps = [k / (points + 1) for k in range(1, points + 1)]
    m, s = df.agg(F.avg(value), F.stddev_samp(value)).first()
    q = quantiles(df, None, {f"q{k}": (value, p) for k, p in enumerate(ps)}).first()
    rows = [(p, x, m + (s or 0.0) * normal_ppf(p)) for p, x in zip(ps, q or [], strict=bool(q))]
    return df.sparkSession.createDataFrame(rows, "p double, sample double, normal double")


def dense_labels(clusters: DataFrame) -> DataFrame:
    """Cluster ids as 0, 1, 2, ... in the order of their roots; noise stays -1. The roots are numbered in range blocks."""
    named = value_ranks(clusters.where("cluster >= 0").select("cluster").distinct(), "cluster").select(F.col("v").alias("_c"), (F.col("rank") - 1).cast("long").alias("label"))
    return clusters.join(named, F.col("cluster") == F.col("_c"), "left").select("id", F.coalesce("label", F.lit(-1)).alias("cluster"), "core")
