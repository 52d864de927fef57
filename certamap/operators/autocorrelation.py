"""Spatial autocorrelation over an edge table (i, j, w), which may be as large as the join that made it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certamap.operators.lineage import cut
from certamap.operators.ranks import value_ranks

QUADRANTS = {1: "High-High", 2: "Low-High", 3: "Low-Low", 4: "High-Low"}
PERMUTATIONS, SEED, SIGNIFICANT, HOT = 999, 42, 0.05, 1.96
#: Decimals to which a statistic and its permuted ones are compared, so that equal draws count as equal whatever the order of their sums.
PLACES = 9


def row_standardised(edges: DataFrame) -> DataFrame:
    """Weights that add up to 1 for every unit."""
    n = edges.groupBy("i").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("i", "_i")
    return edges.join(n, F.col("i") == F.col("_i")).select("i", "j", (F.lit(1.0) / F.col("_n")).alias("w"))


def lags(units: DataFrame, weights: DataFrame, value: str, id_col: str) -> tuple[DataFrame, dict[str, float]]:
    """(id, z, lag) and the scalars n, s2 (sum of z squared), s0. A unit without neighbours has a null lag. Units with a null value are left out."""
    used = units.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("y"))
    mean = used.agg(F.avg("y")).first()[0]
    z = used.withColumn("z", F.col("y") - F.lit(mean))
    zj = z.select(F.col("id").alias("_j"), F.col("z").alias("_zj"))
    met = weights.join(zj, F.col("j") == F.col("_j")).join(z.select(F.col("id").alias("_i")), F.col("i") == F.col("_i"))
    lag = met.groupBy(F.col("i").alias("_k")).agg(F.sum(F.col("w") * F.col("_zj")).alias("lag"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"))
    out = cut(z.join(lag, F.col("id") == F.col("_k"), "left").select("id", "y", "z", "lag", "sw", "sw2"))
    n, s2, s0 = out.agg(F.count(F.lit(1)), F.sum(F.col("z") * F.col("z")), F.sum("sw")).first()
    return out, {"n": n, "s2": s2, "s0": s0, "mean": mean}


def moran_global(units: DataFrame, weights: DataFrame, value: str, id_col: str, permutations: int = 0, seed: int = SEED) -> DataFrame:
    """One row: n, s0, moran_i, and p_sim where there are permutations.

    In permutation r the units' values are dealt to them in the order of md5("seed:r:id"), each in a task of its own: units are the areas of a map.
    """
    out, k = lags(units, weights, value, id_col)
    top = out.agg(F.sum(F.col("z") * F.col("lag"))).first()[0]
    i = k["n"] / k["s0"] * top / k["s2"] if k["s0"] and k["s2"] and top is not None else None
    spark = units.sparkSession
    if not permutations:
        return spark.createDataFrame([(k["n"], k["s0"], i)], "n long, s0 double, moran_i double")
    schema = "n long, s0 double, moran_i double, p_sim double"
    if i is None:
        return spark.createDataFrame([(k["n"], k["s0"], None, None)], schema)
    r = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("r")
    dealt = out.select("id", "z", r).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("id").cast("string"))))
    at = lambda *by: F.row_number().over(Window.partitionBy("r").orderBy(*by))
    ranked = dealt.withColumns({"_to": at("_h", "id"), "_from": at("id")})
    values = cut(ranked.select("r", F.col("id"), "_to").join(ranked.select("r", F.col("_from").alias("_to"), F.col("z").alias("_z")), ["r", "_to"]).select("r", "id", "_z"))
    a = values.select(F.col("r").alias("_ra"), F.col("id").alias("_ia"), F.col("_z").alias("_za"))
    b = values.select(F.col("r").alias("_rb"), F.col("id").alias("_ib"), F.col("_z").alias("_zb"))
    each = a.join(weights, F.col("_ia") == F.col("i")).join(b, (F.col("j") == F.col("_ib")) & (F.col("_ra") == F.col("_rb")))
    sims = each.groupBy("_ra").agg((F.sum(F.col("w") * F.col("_za") * F.col("_zb")) * (k["n"] / k["s0"] / k["s2"])).alias("sim"))
    larger = sims.where(F.round("sim", PLACES) >= round(i, PLACES)).count()
    return spark.createDataFrame([(k["n"], k["s0"], i, (min(larger, permutations - larger) + 1) / (permutations + 1))], schema)


def moran_local(units: DataFrame, weights: DataFrame, value: str, id_col: str) -> DataFrame:
    """(id, z, lag, local_i, q): quadrant 1 HH, 2 LH, 3 LL, 4 HL; null for a unit without neighbours."""
    out, k = lags(units, weights, value, id_col)
    up, high = F.col("z") > 0, F.col("lag") > 0
    q = F.when(F.col("lag").isNotNull(), F.when(up & high, 1).when(~up & high, 2).when(~up, 3).otherwise(4))
    return out.select("id", "z", "lag", F.try_divide((k["n"] - 1) * F.col("z") * F.col("lag"), F.lit(float(k["s2"]))).alias("local_i"), q.alias("q"))


def draws(others: int, most: int, permutations: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """[permutations, most] indexes below `others`, different in a row: the first such that md5("seed:r:t") gives, t = 0, 1, ..."""
    most = min(most, others)
    out = np.zeros((permutations, most), np.int64)
    for r in range(permutations):
        got: dict[int, None] = {}
        t = 0
        while len(got) < most:
            got.setdefault(int(hashlib.md5(f"{seed}:{r + 1}:{t}".encode()).hexdigest()[:8], 16) % others)
            t += 1
        out[r] = list(got)
    return out


def _permuted(rows: DataFrame, weights: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(id, larger): in how many conditional permutations the weighted sum of drawn values, times the unit's scale, is at least its own, times the scale.

    `rows` has id, v, scale and own, the unit's weighted sum of v over its neighbours; a null own gives no count. A unit's neighbours are drawn from the other units without replacement, the
    same indexes for every unit, so values are wanted at 2 * permutations * (most neighbours of a unit) places only, however many units there are.
    """
    spark = rows.sparkSession
    wide = weights.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "w")))["w"].alias("ws"))  # the neighbours of one unit
    placed = value_ranks(rows.select("id"), "id").select(F.col("v").alias("_p"), (F.col("rank") - 1).cast("long").alias("at"))
    rows = cut(rows.join(wide, F.col("id") == F.col("i"), "left").drop("i").join(placed, F.col("id") == F.col("_p")).drop("_p"))
    everyone = cut(placed.join(rows.select(F.col("id").alias("_q"), "v"), F.col("_p") == F.col("_q"), "left").select("at", "v"))
    n, most = everyone.count(), rows.agg(F.max(F.size("ws"))).first()[0] or 0
    if n < 2 or not most:
        return rows.select("id", F.lit(None).cast("long").alias("larger"))
    drawn = draws(n - 1, most, permutations, seed)
    wanted = spark.createDataFrame([(int(x),) for x in np.unique(np.concatenate([drawn.ravel(), drawn.ravel() + 1]))], "_w long")
    value = dict(everyone.join(wanted, F.col("at") == F.col("_w")).select("at", "v").collect())  # as many as the draws name

    before = np.array([[value[x] for x in row] for row in drawn.tolist()])
    after = np.array([[value[x + 1] for x in row] for row in drawn.tolist()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            larger = []
            for at, scale, own, ws in zip(b["at"], b["scale"], b["own"], b["ws"], strict=True):
                w = np.asarray(ws, float)[: drawn.shape[1]]
                sim = np.where(drawn[:, : len(w)] < at, before[:, : len(w)], after[:, : len(w)]) @ w
                larger.append(int((np.round(scale * sim, PLACES) >= round(scale * own, PLACES)).sum()))
            yield pd.DataFrame({"id": b["id"], "larger": larger})

    return rows.where("own is not null").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, larger long")


def _p(larger: Column, permutations: int) -> Column:
    return (F.least(larger, F.lit(permutations) - larger) + 1) / F.lit(float(permutations + 1))


def lisa(units: DataFrame, weights: DataFrame, value: str, id_col: str, permutations: int = PERMUTATIONS, seed: int = SEED, none: str = "NS") -> DataFrame:
    """`moran_local` with p_sim by conditional permutation, sig and lisa_label: the quadrant's name if p_sim < 0.05, else `none`."""
    local = cut(moran_local(units, weights, value, id_col))
    # a unit's statistic is a positive multiple of z times the lag
    counted = _permuted(local.select("id", F.col("z").alias("v"), F.col("z").alias("scale"), F.col("lag").alias("own")), weights.join(local.select(F.col("id").alias("_j")), F.col("j") == F.col("_j")).select("i", "j", "w"), permutations, seed)
    out = local.join(counted.withColumnRenamed("id", "_k"), F.col("id") == F.col("_k"), "left").drop("_k")
    out = out.withColumn("p_sim", F.when(F.col("lag").isNotNull(), _p(F.col("larger"), permutations))).drop("larger")
    sig = F.coalesce(F.col("p_sim") < SIGNIFICANT, F.lit(False))
    name = F.try_element_at(F.create_map(*[F.lit(x) for p in QUADRANTS.items() for x in p]), F.col("q"))
    return out.withColumns({"sig": sig, "lisa_label": F.when(sig, name).otherwise(none)})


def label_counts(labelled: DataFrame, label: str, names: list[str]) -> DataFrame:
    """(label, n, pct): every name, those that no unit has included."""
    n = labelled.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    grid = labelled.sparkSession.createDataFrame([(x,) for x in names], "label string")
    out = grid.join(n, F.col("label") == F.col("_l"), "left").select("label", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("pct", F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(F.lit(0))).cast("double")))


def spots(units: DataFrame, weights: DataFrame, value: str, id_col: str, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """(id, z, p_sim, spot): local G by the given weights, its permutation p, and hot or cold where z is beyond 1.96."""
    z = cut(getis_ord(units, weights, value, id_col))
    used = units.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"))
    known = weights.join(used.select(F.col("id").alias("_j"), F.col("v").alias("_v")), F.col("j") == F.col("_j"))
    own = known.groupBy("i").agg(F.sum(F.col("w") * F.col("_v")).alias("own"))
    counted = _permuted(used.join(own, F.col("id") == F.col("i"), "left").select("id", "v", F.lit(1.0).alias("scale"), "own"), known.select("i", "j", "w"), permutations, seed)
    spot = F.when(F.col("z") > HOT, "hot").when(F.col("z") < -HOT, "cold").otherwise("none")
    return z.join(counted.withColumnRenamed("id", "_k"), F.col("id") == F.col("_k"), "left").select("id", "z", _p(F.col("larger"), permutations).alias("p_sim"), spot.alias("spot"))


def getis_ord(units: DataFrame, edges: DataFrame, value: str, id_col: str, star: bool = False) -> DataFrame:
    """(id, z): local G (or G*, which counts the unit itself) as a standard score, with binary weights unless `edges` has w."""
    used = cut(units.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("y")))
    n, total, square = used.agg(F.count(F.lit(1)), F.sum("y"), F.sum(F.col("y") * F.col("y"))).first()
    w = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    yj = used.select(F.col("id").alias("_j"), F.col("y").alias("_y"))
    own = used.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w"))
    w = w.select("i", "j", "w").union(own) if star else w
    s = w.join(yj, F.col("j") == F.col("_j")).groupBy("i").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("_y")).alias("swy"))
    out = used.join(s, F.col("id") == F.col("i"), "left")
    m = F.lit(float(n))
    if star:
        mean, var, dof = F.lit(total / n), F.lit(square / n - (total / n) ** 2), F.try_divide(m * F.col("sw2") - F.col("sw") ** 2, m - 1)
    else:
        mean = F.try_divide(F.lit(total) - F.col("y"), m - 1)
        var = F.try_divide(F.lit(square) - F.col("y") * F.col("y"), m - 1) - mean * mean
        dof = F.try_divide((m - 1) * F.col("sw2") - F.col("sw") ** 2, m - 2)
    return out.select("id", F.try_divide(F.col("swy") - F.col("sw") * mean, F.sqrt(var) * F.sqrt(dof)).alias("z"))
