"""Regressions from sums that one pass over the rows gives; the driver solves systems as small as the number of features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certamap.functions.distributions import normal_ppf, normal_two_sided, t_ppf, t_two_sided
from certamap.operators.segments import sample_n

COEFFICIENTS = "variable string, coef double, std_err double, p_value double, ci_low double, ci_high double"


def _complete(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in (target, *features)]).dropna()


def _moments(df: DataFrame, target: str, features: list[str]) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, y'y, the mean of y and n, the constant first."""
    cols = [F.lit(1.0), *map(F.col, features)]
    k = len(cols)
    aggs = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(target)) for c in cols] + [F.sum(F.col(target) ** 2)]
    got = [float(x or 0.0) for x in _complete(df, target, features).agg(*aggs).first()]
    xx, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = got[at]
            at += 1
    xy, yy, n = np.array(got[at : at + k]), got[-1], int(round(xx[0, 0]))
    return xx, xy, yy, float(xy[0]) / n if n else 0.0, n


def ols(df: DataFrame, target: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Coefficients (six columns, the constant first) and one row of fit: n, r2, adj_r2, aic, bic, log_lik."""
    spark = df.sparkSession
    xx, xy, yy, mean, n = _moments(df, target, features)
    k = len(xy)
    beta = np.linalg.solve(xx, xy)
    rss = max(0.0, yy - float(beta @ xy))
    tss = yy - n * mean * mean
    err = np.sqrt(np.diag(np.linalg.inv(xx)) * rss / (n - k))
    q = t_ppf(0.975, n - k)
    rows = [(name, float(b), float(e), t_two_sided(float(b / e), n - k) if e else None, float(b - q * e), float(b + q * e)) for name, b, e in zip(["const", *features], beta, err, strict=True)]
    r2 = 1 - rss / tss if tss else None
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1) if rss else None
    fit = (n, r2, None if r2 is None else 1 - (1 - r2) * (n - 1) / (n - k), None if ll is None else 2 * k - 2 * ll, None if ll is None else k * math.log(n) - 2 * ll, ll)
    return spark.createDataFrame(rows, COEFFICIENTS), spark.createDataFrame([fit], "n long, r2 double, adj_r2 double, aic double, bic double, log_lik double")


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr): the lower triangle, each pair over the rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    one = df.agg(*[both(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])))


def spatial_error(units: DataFrame, edges: DataFrame, target: str, features: list[str], id_col: str, most: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Spatial error model by maximum likelihood: y = Xb + u, u = lambda W u + e, W row-standardised.

    Rows with nulls go before the weights are built. The determinant needs the eigenvalues of W, so units are
    areas of a map, `most` of them at the most; more raise an error.
    """
    spark = units.sparkSession
    rows = units.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in (target, *features)]).dropna().orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the spatial error model is for {most} units at the most")
    at = {r["id"]: k for k, r in enumerate(rows)}
    ids = spark.createDataFrame([(i,) for i in at], f"k {dict(units.dtypes)[id_col]}")
    near = edges.join(ids, F.col("i") == F.col("k"), "left_semi").join(ids, F.col("j") == F.col("k"), "left_semi").select("i", "j").collect()
    n = len(rows)
    w = np.zeros((n, n))
    for i, j in near:
        w[at[i], at[j]] = 1
    w = w / np.maximum(w.sum(axis=1, keepdims=True), 1)
    y = np.array([r[target] for r in rows])
    x = np.column_stack([np.ones(n), *([r[f] for r in rows] for f in features)])
    roots = np.linalg.eigvals(w)

    def at_lambda(lam: float) -> tuple[float, np.ndarray, float]:
        ys, xs = y - lam * (w @ y), x - lam * (w @ x)
        b = np.linalg.lstsq(xs, ys, rcond=None)[0]
        s2 = float(((ys - xs @ b) ** 2).sum()) / n
        return -n / 2 * (math.log(2 * math.pi) + 1) - n / 2 * math.log(s2) + float(np.log(np.abs(1 - lam * roots)).sum()), b, s2

    lo, hi, g = -0.99, 0.99, (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if at_lambda(a)[0] > at_lambda(b)[0] else (a, hi)
    lam = (lo + hi) / 2
    ll, beta, s2 = at_lambda(lam)
    xs = x - lam * (w @ x)
    err = np.sqrt(np.diag(np.linalg.inv(xs.T @ xs)) * s2)
    z = normal_ppf(0.975)
    table = [(name, float(b), float(e), normal_two_sided(float(b / e)), float(b - z * e), float(b + z * e)) for name, b, e in zip(["const", *features], beta, err, strict=True)]
    k = len(beta)
    r2 = float(np.corrcoef(x @ beta, y)[0, 1] ** 2) if k > 1 else 0.0
    fit = (n, r2, 2 * k - 2 * ll, k * math.log(n) - 2 * ll, ll, float(lam))
    return spark.createDataFrame(table, COEFFICIENTS), spark.createDataFrame([fit], "n long, r2 double, aic double, bic double, log_lik double, lambda double")


def compare_models(ols_fit: DataFrame, sem_fit: DataFrame) -> DataFrame:
    """(metric, ols, sem): six rows; what a model does not have is null."""
    o, s = ols_fit.first(), sem_fit.first()
    rows = [("R2", o["r2"], s["r2"]), ("Adj R2", o["adj_r2"], None), ("AIC", o["aic"], s["aic"]), ("BIC", o["bic"], s["bic"]), ("Log-Lik", o["log_lik"], s["log_lik"]), ("Lambda", None, s["lambda"])]
    return ols_fit.sparkSession.createDataFrame(rows, "metric string, ols double, sem double")


def gwr(df: DataFrame, target: str, features: list[str], id_col: str = "addr_id", most: int = 5000, seed: int = 42, neighbours: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Geographically weighted regression with an adaptive bisquare kernel: (id, local_r2, coefficients) and {neighbours, aicc, r2, adj_r2}.

    Runs on a seeded sample of `most` rows, as every point is weighed against all; the sample is what is broadcast. Without
    `neighbours` a golden-section search minimises AICc.
    """
    spark = df.sparkSession
    cols = [target, *features]
    whole = df.select(id_col, "x", "y", *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    pts = sample_n(whole, most, seed, id_col).toPandas().sort_values(id_col).reset_index(drop=True)
    n, k = len(pts), len(features) + 1
    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, fitted double, lever double, local_r2 double, coefs array<double>"
    if n <= k + 2:
        return spark.createDataFrame([], schema).select("id", "local_r2", "coefs"), {"neighbours": n, "aicc": math.nan, "r2": math.nan, "adj_r2": math.nan}
    shared = spark.sparkContext.broadcast((pts[["x", "y"]].to_numpy(float), np.column_stack([np.ones(n), pts[features].to_numpy(float)]), pts[target].to_numpy(float), pts[id_col].to_numpy()))
    index = spark.range(n).repartition(min(64, max(1, n // 64)))

    def fitted(m: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            xy, x, y, ids = shared.value
            for b in batches:
                out = []
                for r in b["id"]:
                    d = np.sqrt(((xy - xy[r]) ** 2).sum(axis=1))
                    reach = np.partition(d, min(m, n - 1))[min(m, n - 1)] or 1.0
                    w = np.where(d < reach, (1 - (d / reach) ** 2) ** 2, 0.0)
                    xw = x * w[:, None]
                    inv = np.linalg.pinv(xw.T @ x)
                    beta = inv @ (xw.T @ y)
                    e = y - x @ beta
                    mean = (w * y).sum() / w.sum()
                    tss = (w * (y - mean) ** 2).sum()
                    out.append((ids[r], float(x[r] @ beta), float(x[r] @ inv @ x[r] * w[r]), float(1 - (w * e * e).sum() / tss) if tss > 0 else None, beta.tolist()))
                yield pd.DataFrame(out, columns=["id", "fitted", "lever", "local_r2", "coefs"])

        return index.mapInPandas(run, schema)

    actual = spark.createDataFrame(pts[[id_col, target]].rename(columns={id_col: "_id", target: "_y"}))

    def judged(m: int) -> tuple[float, float, float]:
        rss, lever = fitted(m).join(actual, F.col("id") == F.col("_id")).agg(F.sum((F.col("_y") - F.col("fitted")) ** 2), F.sum("lever")).first()
        y = pts[target].to_numpy(float)
        tss = float(((y - y.mean()) ** 2).sum())
        if n - 2 - lever <= 0 or rss <= 0:
            return math.inf, 1.0, 1.0
        r2 = 1 - rss / tss if tss else math.nan
        return 2 * n * math.log(math.sqrt(rss / n)) + n * math.log(2 * math.pi) + n * (n + lever) / (n - 2 - lever), r2, 1 - (1 - r2) * (n - 1) / (n - lever - 1)

    if neighbours is None:
        lo, hi, g = k + 3, n - 1, (math.sqrt(5) - 1) / 2
        seen: dict[int, float] = {}
        cost = lambda m: seen.setdefault(m, judged(m)[0]) if m not in seen else seen[m]
        while hi - lo > 3:
            a, b = round(hi - g * (hi - lo)), round(lo + g * (hi - lo))
            if a >= b:
                break
            lo, hi = (lo, b) if cost(a) <= cost(b) else (a, hi)
        neighbours = min(range(lo, hi + 1), key=cost)
    aicc, r2, adj = judged(neighbours)
    return fitted(neighbours).select("id", "local_r2", "coefs"), {"neighbours": neighbours, "aicc": aicc, "r2": r2, "adj_r2": adj}
