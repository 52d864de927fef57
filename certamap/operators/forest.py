"""Random forests, their importances, and exact Shapley values by tree-path expectations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certamap.operators.lineage import cut, fresh_path
from certamap.operators.segments import sample_n


def prepared(df: DataFrame, target: str, features: list[str], id_col: str, most: int | None = 50_000, seed: int = 42, fill: float | None = None) -> DataFrame:
    """(id, y, features): rows with a target; feature nulls are filled or their rows dropped; a seeded sample of `most` rows."""
    rows = df.select(F.col(id_col).alias("id"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).where("y is not null")
    rows = rows.fillna(fill, subset=features) if fill is not None else rows.dropna(subset=features)
    return cut(sample_n(rows, most, seed, "id") if most else rows)


def fit(rows: DataFrame, features: list[str], trees: int = 200, depth: int = 10, seed: int = 42) -> RandomForestRegressionModel:
    made = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    return RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed).fit(made)


def importance(model: RandomForestRegressionModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance, r2): impurity importances, largest first, with the training R2. Features from which the target is computed restate the formula."""
    made = model.transform(VectorAssembler(inputCols=features, outputCol="x").transform(rows))
    r2 = RegressionEvaluator(labelCol="y", metricName="r2").evaluate(made)
    got = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda p: (-p[1], p[0]))
    return rows.sparkSession.createDataFrame([(f, v, r2) for f, v in got], "feature string, importance double, r2 double")


def permutation_importance(model: RandomForestRegressionModel, rows: DataFrame, features: list[str], repeats: int = 5, most: int = 5000, seed: int = 42) -> DataFrame:
    """(feature, importance): mean drop in R2 when a feature's values are dealt anew among the first `most` rows by id."""
    spark = rows.sparkSession
    frame = rows.orderBy("id").limit(most).toPandas()
    judge = RegressionEvaluator(labelCol="y", metricName="r2")
    made = lambda p: judge.evaluate(model.transform(VectorAssembler(inputCols=features, outputCol="x").transform(spark.createDataFrame(p))))
    base, rng, out = made(frame), np.random.default_rng(seed), []
    for f in features:
        drops = [base - made(frame.assign(**{f: rng.permutation(frame[f].to_numpy())})) for _ in range(repeats)]
        out.append((f, float(np.mean(drops))))
    return spark.createDataFrame(sorted(out, key=lambda p: (-p[1], p[0])), "feature string, importance double")


def _trees(model: RandomForestRegressionModel, spark) -> list[dict[str, np.ndarray]]:
    """The trees as arrays of feature, threshold, children, value and cover, read back from the saved model."""
    path = fresh_path(spark)
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    rows = nodes.select("treeID", "id", "prediction", "rawCount", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"), F.col("split.leftCategoriesOrThreshold").alias("t")).toPandas()
    out = []
    for _, t in rows.groupby("treeID"):
        t = t.sort_values("id")
        out.append({"f": t["f"].to_numpy(int), "t": np.array([float(x[0]) if len(x) else 0.0 for x in t["t"]]), "l": t["leftChild"].to_numpy(int), "r": t["rightChild"].to_numpy(int), "v": t["prediction"].to_numpy(float), "n": t["rawCount"].to_numpy(float)})
    return out


def expectation(tree: dict[str, np.ndarray], x: np.ndarray, known: frozenset[int]) -> np.ndarray:
    """A tree's value for every row when only the `known` features are: other splits average their children by cover."""
    out, stack = np.zeros(len(x)), [(0, np.ones(len(x)))]
    while stack:
        k, w = stack.pop()
        if not w.any():
            continue
        if tree["l"][k] < 0:
            out += w * tree["v"][k]
            continue
        a, b = int(tree["l"][k]), int(tree["r"][k])
        left = (x[:, tree["f"][k]] <= tree["t"][k]).astype(float) if int(tree["f"][k]) in known else tree["n"][a] / (tree["n"][a] + tree["n"][b])
        stack += [(a, w * left), (b, w * (1 - left))]
    return out


def shapley(model: RandomForestRegressionModel, rows: DataFrame, features: list[str], most: int | None = None) -> DataFrame:
    """(id, base, prediction, one phi_ column a feature) for all rows, or the first `most` by id; base and phis add up to the prediction. For up to five features: all coalitions are walked."""
    if len(features) > 5:
        raise ValueError("exact Shapley values are for five features at the most")
    spark, p = rows.sparkSession, len(features)
    shared = spark.sparkContext.broadcast(_trees(model, spark))
    kind = dict(rows.dtypes)["id"]
    names = [f"phi_{f}" for f in features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for b in batches:
            x = b[features].to_numpy(float)
            value = {frozenset(c): sum(expectation(t, x, frozenset(c)) for t in trees) / len(trees) for k in range(p + 1) for c in combinations(range(p), k)}
            out = {"id": b["id"], "base": value[frozenset()], "prediction": value[frozenset(range(p))]}
            for j, name in enumerate(names):
                rest = [i for i in range(p) if i != j]
                out[name] = sum(factorial(len(c)) * factorial(p - len(c) - 1) / factorial(p) * (value[frozenset((*c, j))] - value[frozenset(c)]) for k in range(p) for c in combinations(rest, k))
            yield pd.DataFrame(out)

    top = rows if most is None else rows.orderBy("id").limit(most)
    return top.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, ", ".join([f"id {kind}", "base double", "prediction double", *(f"`{n}` double" for n in names)]))


def shapley_summary(values: DataFrame, features: list[str]) -> DataFrame:
    one = values.agg(*[F.avg(F.abs(F.col(f"`phi_{f}`"))).alias(f) for f in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_phi")) for f in features]))).orderBy(F.desc("mean_abs_phi"), "feature")
