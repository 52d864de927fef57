"""Operators on small inputs: hand-computed values, brute force, invariants and empty cases."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from certamap.functions import geometry as G
from certamap.operators import autocorrelation as A
from certamap.operators import clusters as K
from certamap.operators import forest as X
from certamap.operators import ranks as T
from certamap.operators import regression as R
from certamap.operators import segments as S
from certamap.operators import spatial_joins as J
from certamap.sources import layers as L
from certamap.streaming import scoring


def test_error_measures(spark):
    d = F.col("d")
    row = spark.createDataFrame([(3.0,), (4.0,), (None,)], "d double").agg(S.rmse(d), S.mae(d)).first()
    assert list(row) == pytest.approx([math.sqrt(12.5), 3.5])


@pytest.mark.parametrize("block", [50_000, 40])
def test_quantiles_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else "cold", float(round(v, 1 + i % 3)), float(i % 7) if i % 5 else None) for i, v in enumerate(rng.normal(size=900))] + [(None, 9.0, 9.0), ("none", None, None), ("one", 4.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["k"]: r for r in S.quantiles(df, "k", {"m": ("a", 0.5), "h": ("a", 0.9), "b": ("b", 0.25)}).collect()}
    for k in ("hot", "cold"):
        a, b = np.array([r[1] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k and r[2] is not None])
        assert list(got[k][1:]) == pytest.approx([np.quantile(a, 0.5), np.quantile(a, 0.9), np.quantile(b, 0.25)])
    assert tuple(got["one"]) == ("one", 4.0, 4.0, None) and set(got) == {"hot", "cold", "one"}
    everything = S.quantiles(df, None, {"m": ("a", 0.5)}).first()[0]
    assert everything == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], 0.5))
    assert S.quantiles(df.limit(0), None, {"m": ("a", 0.5)}).count() == 0


def test_metrics_by_segment_without_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "k string, match_distance double")
    got = S.metrics_by_segment(df, "k").collect()
    assert len(got) == 1 and got[0]["n"] == 2 and got[0]["pct"] == pytest.approx(200 / 3) and got[0]["lci_mean"] is None
    assert S.metrics_by_segment(df.limit(0), "k").count() == 0


def test_entropy(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("a", 0.9), ("a", 0.9), ("b", 1.0), ("b", 7.0), (None, 0.5)], "k string, v double")
    assert {r[0]: abs(r[1]) for r in S.entropy_by(df, "k", "v").collect()} == {"a": 1.0, "b": 0.0}


def test_resolve_column(spark):
    df = spark.createDataFrame([], "id long, NM_Zona string, declive double")
    assert S.resolve_column(df, ["sigla", "zona"]) == "NM_Zona"
    assert S.resolve_column(df, ["none"], exclude=("id",), numeric=True) == "declive"


@pytest.fixture(scope="module")
def scatter(spark):
    rng = random.Random(2)
    pts = [(i, float(rng.randint(0, 300)), float(rng.randint(0, 300)), rng.random()) for i in range(200)]
    return pts, spark.createDataFrame(pts, "addr_id long, x double, y double, v double")


def test_nearest_and_pairs(spark, scatter):
    pts, df = scatter
    segs = [(k, 30.0 * k, 20.0 * k, 30.0 * k + 25, 20.0 * k + (k % 3) * 10) for k in range(10)] + [(99, 30.0, 20.0, 55.0, 30.0)]
    right = spark.createDataFrame(segs, "rid long, x1 double, y1 double, x2 double, y2 double")

    def d2(px, py, s):
        _, a, b, c, d = s
        n = (c - a) ** 2 + (d - b) ** 2
        t = min(1, max(0, ((px - a) * (c - a) + (py - b) * (d - b)) / n)) if n else 0
        return (px - a - t * (c - a)) ** 2 + (py - b - t * (d - b)) ** 2

    got = {}
    for r in J.nearest(df, right, 40.0, []).collect():
        got.setdefault(r["addr_id"], set()).add(r["rid"])
    for i, x, y, _ in pts:
        near = [(d2(x, y, s), s[0]) for s in segs if d2(x, y, s) <= 1600]
        assert got[i] == ({k for d, k in near if d == min(near)[0]} or {None})
    first = J.nearest(df, right, 40.0, [], ties="first")
    assert first.count() == len(pts)
    pairs = {(r["i"], r["j"]) for r in J.pairs_within(df, 25.0).collect()}
    assert pairs == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 625}


def test_k_nearest(scatter):
    pts, df = scatter
    got = {}
    for r in J.k_nearest(df, 8, 10.0).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    for i, x, y, _ in pts:
        want = sorted((math.sqrt((x - b[1]) ** 2 + (y - b[2]) ** 2), b[0]) for b in pts if b[0] != i)[:8]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    assert J.k_nearest(df.limit(1), 8, 10.0).count() == 0


def test_overlapping_polygons_repeat_rows(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    polys = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring], "a"), (2, [{"x": x, "y": y} for x, y in ring], "b")], "poly_id long, ring array<struct<x:double,y:double>>, name string")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.0, 5.0), (3, None, 1.0)], "addr_id long, x double, y double")
    assert sorted((r["addr_id"], r["poly_id"] or 0) for r in J.points_in_polygons(pts, polys, ["name"], 3.0).collect()) == [(1, 1), (1, 2), (2, 0), (3, 0)]
    assert sorted((r["addr_id"], r["poly_id"] or 0) for r in J.points_in_polygons(pts, polys, ["name"], 3.0, ties="first").collect()) == [(1, 1), (2, 0), (3, 0)]


def test_ranks_and_tests(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 5.0), ("c", 3.0), ("c", None)], "k string, v double")
    assert {r["v"]: r["rank"] for r in T.value_ranks(df, "v").collect()} == {1.0: 1.5, 2.0: 3.0, 3.0: 4.0, 5.0: 5.0}
    h = T.kruskal_wallis(df, "v", "k").first()
    ties = 1 - 6 / (125 - 5)
    assert h["h"] == pytest.approx((12 / 30 * (9 / 2 + 64 / 2 + 16) - 18) / ties) and h["n_groups"] == 3
    one = T.kruskal_wallis(df.where("k = 'a'"), "v", "k").first()
    assert one["h"] is None and one["significant"] is False
    m = T.mann_whitney(df, "v", "k", "a", "c").first()
    assert m["u"] is None and (m["n_a"], m["n_b"]) == (2, 1)
    # with two groups H is the square of the uncorrected z
    two = spark.createDataFrame([("a", float(v)) for v in (1, 4, 4, 7)] + [("b", float(v)) for v in (2, 4, 9, 11, 12)], "k string, v double")
    h, u = T.kruskal_wallis(two, "v", "k").first()["h"], T.mann_whitney(two, "v", "k", "a", "b").first()["u"]
    sd = math.sqrt(20 / 12 * (10 - 24 / 72))
    assert h == pytest.approx(((u - 10) / sd) ** 2)
    s = T.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 8.0), (None, 1.0)], "a double, b double"), "a", "b").first()
    assert (s["rho"], s["n"]) == (pytest.approx(1.0), 3)
    assert T.spearman(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "a", "b").first()["rho"] is None


def test_gini_and_lorenz(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    assert K.gini(df, "v").first()["gini"] == pytest.approx(2 / 9)
    assert K.gini(df.where("v is null"), "v").first()["gini"] is None
    assert [r["share_of_value"] for r in K.lorenz(df, "v", 3).orderBy("step").collect()] == pytest.approx([1 / 6, 1 / 2, 1])


def test_dbscan_against_plain(scatter):
    pts, df = scatter
    eps, least = 22.0, 5
    near = {a[0]: {b[0] for b in pts if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= eps * eps} for a in pts}
    core = {i for i, n in near.items() if len(n) >= least}
    root = {i: i for i in core}
    for _ in pts:
        for i in core:
            root[i] = min(root[j] for j in near[i] & core)
    want = {i: root[i] if i in core else min((root[j] for j in near[i] & core), default=-1) for i in near}
    assert {r["id"]: r["cluster"] for r in K.dbscan(df, eps, least).collect()} == want


def test_moran_and_permutations(spark):
    grid = [(r * 5 + c, float(r)) for r in range(5) for c in range(5)]
    df = spark.createDataFrame(grid, "id long, y double")
    edges = spark.createDataFrame([(a, b) for a, _ in grid for b, _ in grid if a != b and abs(a // 5 - b // 5) <= 1 and abs(a % 5 - b % 5) <= 1], "i long, j long")
    w = A.row_standardised(edges)
    assert A.moran_global(df, w, "y", "id").first()["moran_i"] > 0.5
    rows = A.lisa(df, w, "y", "id", permutations=199).collect()
    assert all(0 < r["p_sim"] <= 1 for r in rows) and {r["lisa_label"] for r in rows} <= {"High-High", "Low-High", "Low-Low", "High-Low", "NS"}
    again = A.lisa(df.repartition(3), w, "y", "id", permutations=199).collect()
    assert {r["id"]: r["p_sim"] for r in rows} == {r["id"]: r["p_sim"] for r in again}


def test_permutations_by_hand(spark):
    """The local p-values from the drawn indexes, unit by unit; lone units and those without a value have none."""
    rng = np.random.default_rng(8)
    y = rng.normal(size=40)
    df = spark.createDataFrame([*((10 * i, float(v)) for i, v in enumerate(y)), (5000, None)], "id long, y double")
    pairs = [(10 * i, 10 * j) for i in range(39) for j in range(39) if 0 < abs(i - j) <= 1 + i % 3] + [(10, 5000)]
    w = A.row_standardised(spark.createDataFrame(pairs, "i long, j long"))
    got = {r["id"]: r for r in A.lisa(df, w, "y", "id", none="Not Significant").collect()}
    assert got[390]["p_sim"] is None and got[390]["lisa_label"] == "Not Significant" and 5000 not in got
    z, most = y - y.mean(), max(sum(a == 10 * i and b < 5000 for a, b in pairs) for i in range(39))
    drawn = A.draws(39, most)
    assert drawn.shape == (999, most) and all(len(set(r)) == most for r in drawn.tolist()) and drawn.max() <= 38
    weight = {(r["i"], r["j"]): r["w"] for r in w.collect()}
    for i in range(39):
        near = [b // 10 for a, b in sorted(pairs) if a == 10 * i and b < 5000]
        ws = np.array([weight[10 * i, 10 * j] for j in near])
        others = np.delete(z, i)
        sims = z[i] * (others[drawn[:, : len(near)]] @ ws)
        larger = int((np.round(sims, 9) >= round(z[i] * float(z[near] @ ws), 9)).sum())
        assert got[10 * i]["p_sim"] == pytest.approx((min(larger, 999 - larger) + 1) / 1000)
    spot = A.spots(df, w, "y", "id", permutations=99).collect()
    assert {r["spot"] for r in spot} <= {"hot", "cold", "none"} and len(spot) == 40
    assert [r["n"] for r in A.label_counts(spark.createDataFrame([("a",), ("a",)], "l string"), "l", ["a", "b"]).orderBy("label").collect()] == [2, 0]


def test_points_in_odd_rings(spark):
    """Concave rings, rings far larger and far smaller than the cells, points on lines, and polygons that overlap."""
    rings = {1: [(0, 0), (90, 0), (90, 90), (45, 20), (0, 90)], 2: [(3, 3), (3.5, 3), (3.5, 3.5), (3, 3.5)], 3: [(-400, -400), (400, -380), (380, 400), (-390, 390)]}
    polys = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]]) for k, r in rings.items()], "poly_id long, ring array<struct<x:double,y:double>>")
    rng = np.random.default_rng(2)
    pts = [(float(x), float(y)) for x, y in rng.uniform(-450, 450, (300, 2))] + [(float(x), float(y)) for x, y in rng.uniform(0, 90, (300, 2))] + [(0.0, 0.0), (45.0, 0.0), (3.2, 3.2), (45.0, 20.0), (-400.0, -400.0)]

    def inside(x, y, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "addr_id long, x double, y double")
    want = sorted((i, k) for i, p in enumerate(pts) for k in ([k for k, r in rings.items() if inside(*p, r)] or [0]))
    for side in (7.0, 60.0, 2000.0):
        got = J.points_in_polygons(df, polys, [], side).select("addr_id", F.coalesce("poly_id", F.lit(0))).collect()
        assert sorted(map(tuple, got)) == want
        first = J.points_in_polygons(df, polys, [], side, ties="first").select("addr_id", F.coalesce("poly_id", F.lit(0))).collect()
        assert sorted(map(tuple, first)) == sorted({i: k for i, k in reversed(want)}.items())


def test_dbscan_of_equal_points(spark):
    rows = spark.range(20_000).selectExpr("id AS addr_id", "cast(5 AS double) AS x", "cast(5 AS double) AS y").union(spark.createDataFrame([(30_000, 9.0, 5.0), (30_001, 900.0, 5.0)], "a long, b double, c double"))
    got = K.dbscan(rows, 10.0, 50).groupBy("cluster", "core").count().collect()
    assert sorted(map(tuple, got)) == [(-1, False, 1), (0, True, 20_001)]
    labels = K.dense_labels(spark.createDataFrame([(1, 70, True), (2, 9, True), (3, -1, False), (4, 70, False)], "id long, cluster long, core boolean"))
    assert {r["id"]: r["cluster"] for r in labels.collect()} == {1: 1, 2: 0, 3: -1, 4: 1}


def test_violin_is_a_density(spark):
    rng = np.random.default_rng(6)
    v = rng.uniform(0, 1, 400)
    df = spark.createDataFrame([("a" if i % 4 else "b", float(x)) for i, x in enumerate(v)] + [("c", 0.5), (None, 0.1)], "k string, v double")
    got = S.violin(df, "k", "v", top=2).toPandas()
    own = v[[i for i in range(400) if i % 4]]
    h = own.std(ddof=1) * len(own) ** -0.2
    for r in got[got["k"] == "a"].itertuples():
        assert r.density == pytest.approx(np.exp(-((r.place - own) ** 2) / (2 * h * h)).sum() / (len(own) * h * math.sqrt(2 * math.pi)), rel=0.01)
    assert set(got["k"]) == {"a", "b"} and len(got) == 42


def test_utm_on_the_meridian(spark):
    """Northings on the central meridian are the scaled arc of the ellipse, by integration; eastings grow with it by the parallel's radius."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    for lat in (-19.9, -5.0, -33.25):
        steps = np.linspace(0, math.radians(lat), 200_001)
        arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5, steps)
        x, y = G.to_utm(F.lit(-45.0), F.lit(lat))
        r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert r["x"] == pytest.approx(500_000, abs=1e-4) and r["y"] == pytest.approx(10_000_000 + 0.9996 * arc, abs=1e-3)
        x2, _ = G.to_utm(F.lit(-45.0 + 1e-4), F.lit(lat))
        wide = a * math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2) * math.radians(1e-4) * 0.9996
        assert spark.range(1).select(x2).first()[0] - 500_000 == pytest.approx(wide, abs=1e-4)


def test_ols_and_sem(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = 2 + 3 * x + rng.normal(scale=0.1, size=60)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, a double, b double")
    table, fit = R.ols(df, "b", ["a"])
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert [r["coef"] for r in table.collect()] == pytest.approx(want.tolist())
    edges = spark.createDataFrame([(i, j) for i in range(60) for j in (i - 1, i + 1) if 0 <= j < 60], "i long, j long")
    sem, sem_fit = R.spatial_error(df, edges, "b", ["a"], "id")
    assert [r["coef"] for r in sem.collect()] == pytest.approx([2, 3], abs=0.1)
    assert sem_fit.first()["log_lik"] >= fit.first()["log_lik"] - 1e-6
    assert [r["metric"] for r in R.compare_models(fit, sem_fit).collect()] == ["R2", "Adj R2", "AIC", "BIC", "Log-Lik", "Lambda"]


def test_gwr_finds_the_slope(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.uniform(0, 100)), float(rng.uniform(0, 100)), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame([(*r, 1 + 2 * r[3]) for r in rows], "addr_id long, x double, y double, f double, t double")
    got, fit = R.gwr(df, "t", ["f"], neighbours=40)
    assert all(r["local_r2"] > 0.999 and r["coefs"][1] == pytest.approx(2) for r in got.collect()) and fit["r2"] > 0.999


def test_shapley_adds_up(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), float(a * 2 + (b > 0) * 3)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    df = spark.createDataFrame(rows, "addr_id long, a double, b double, t double")
    got = X.prepared(df, "t", ["a", "b"], "addr_id")
    model = X.fit(got, ["a", "b"], trees=5, depth=4)
    phi = X.shapley(model, got, ["a", "b"], most=40).orderBy("id").toPandas()
    assert np.allclose(phi["base"] + phi["phi_a"] + phi["phi_b"], phi["prediction"])
    direct = [model.predict(__import__("pyspark.ml.linalg", fromlist=["Vectors"]).Vectors.dense(r[1], r[2])) for r in rows[:40]]
    assert np.allclose(phi["prediction"], direct)
    assert X.importance(model, got, ["a", "b"]).count() == 2


def test_shapley_takes_every_row(spark):
    df = spark.range(6000).selectExpr("id AS addr_id", "cast(id % 7 AS double) AS a", "cast(id >= 5000 AS double) AS b", "cast(id >= 5000 AS double) * 9 + id % 7 AS t")
    got = X.prepared(df, "t", ["a", "b"], "addr_id")
    phi = X.shapley(X.fit(got, ["a", "b"], trees=2, depth=4), got, ["a", "b"]).toPandas()
    assert sorted(phi["id"]) == list(range(6000))
    late = phi["id"] >= 5000
    assert phi.loc[late, "phi_b"].min() > 0 > phi.loc[~late, "phi_b"].max()
    one = X.shapley_summary(spark.createDataFrame(phi), ["a", "b"]).collect()
    assert {r["feature"]: r["mean_abs_phi"] for r in one} == pytest.approx({"a": phi["phi_a"].abs().mean(), "b": phi["phi_b"].abs().mean()})


def test_bootstrap_bounds(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(300)], "id long, v double")
    r = K.bootstrap(df, "v", "id", replicates=60).first()
    assert r["ci_low"] < 4.5 < r["ci_high"]


def test_wkb_and_shapefile(spark, tmp_path):
    wkb = struct.pack("<BIdd", 1, 1, 3.5, -2.0)
    df = spark.createDataFrame([(bytearray(wkb), float("nan")), (None, 1.0)], "geometry binary, v double")
    df.write.parquet(str(tmp_path / "p"))
    got = sorted(map(str, L.read_points(spark, str(tmp_path / "p")).select("x", "y", "v").collect()))
    assert got == ["Row(x=3.5, y=-2.0, v=None)", "Row(x=None, y=None, v=1.0)"]
    ring = struct.pack("<BIIIdddddd", 1, 3, 1, 3, 0, 0, 1, 0, 0, 1)
    assert spark.createDataFrame([(bytearray(ring),)], "g binary").select(L.wkb_ring("g")).first()[0][1]["x"] == 1.0
    body = struct.pack("<I4dII", 3, 0, 0, 1, 1, 1, 2) + struct.pack("<I", 0) + struct.pack("<4d", 0, 0, 1, 1)
    (tmp_path / "l.shp").write_bytes(b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body)
    head = struct.pack("<BBBBIHH", 3, 0, 0, 0, 1, 65, 6).ljust(32, b"\0") + b"NOME".ljust(11, b"\0") + b"C\0\0\0\0" + bytes([5]) + b"\0" * 15 + b"\r"
    (tmp_path / "l.dbf").write_bytes(head + b" abc  ")
    rows = L.read_shapefile(spark, str(tmp_path / "l.shp")).collect()
    assert len(rows) == 1 and rows[0]["attrs"] == {"NOME": "abc"} and rows[0]["ring"][1]["y"] == 1.0


def test_scores_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, cod_especie int, cod_tipo_especi int, nv_geo_coord int, cep string, complemento string, match_distance double, textual_sim double"
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 1 cod_especie, 103 cod_tipo_especi, 1 nv_geo_coord, '1' cep, 'x' complemento, 50D match_distance, 80D textual_sim")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = scoring.write_parquet(scoring.scored_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert got["gci"] == pytest.approx(1.0 * 0.65 * 0.5) and got["nv_geo_label"] == "Medido em campo"
    counts = scoring.method_counts(stream, "ts")
    assert counts.isStreaming and "gci_mean" in counts.columns
