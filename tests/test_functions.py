"""Hand-computed values of scores, geometry and distribution functions."""

import math

import pytest
from pyspark.sql import functions as F

from certamap.functions import certainty as C
from certamap.functions import distributions as D
from certamap.functions import geometry as G


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_lci(spark):
    assert column(spark, [1, 2, 3, 4, 6, 5, None], "int", C.lci) == [1.0, 0.8, 0.5, 0.3, 0.1, 0.1, 0.1]


def test_completeness(spark):
    schema = "cep string, lograd_num int, complemento string, dsc_localidade string, nv_geo_coord int"
    rows = [("1", 0, None, None, None), ("1", 2, "x", "y", 1), (None, None, " \t", "", None)]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(C.completeness(df)).collect()] == [0.6, 1.0, 0.0]
    part = df.select("cep")
    assert [r[0] for r in part.select(C.completeness(part)).collect()] == [0.3, 0.3, 0.0]


def test_mci_pci_gci(spark):
    df = spark.createDataFrame([(50.0, 80.0), (150.0, 100.0), (None, 80.0), (0.0, None)], "d double, s double")
    assert [r[0] for r in df.select(C.mci(F.col("d"), F.col("s"))).collect()] == [pytest.approx(0.65), 0.5, None, None]
    df = spark.createDataFrame([(103, None), (None, "EDIFÍCIO SOL"), (None, "LOJAS"), (None, "SALÃO"), (101, None)], "cod_tipo_especi int, complemento string")
    assert [r[0] for r in df.select(C.pci(df)).collect()] == [0.5, 0.5, 0.5, 1.0, 1.0]
    assert spark.range(1).select(C.gci(F.lit(0.8), F.lit(0.65), F.lit(0.5))).first()[0] == pytest.approx(0.26)


def test_land_use_first_rule_wins(spark):
    assert column(spark, ["MISTO RESIDENCIAL", "misto", "Saude", "x", None], "string", C.land_use_class) == ["Residencial", "Comercial", "Institucional", "Outros", "Outros"]


def test_text_similarity(spark):
    df = spark.createDataFrame([("Rua  A", "a rua"), ("kitten", "sitting"), (None, "x"), ("", " "), ("abc", "")], "a string, b string")
    got = [r[0] for r in df.select(C.text_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [100.0, pytest.approx(200 * 4 / 13), 0.0, 100.0, 0.0]


def test_nan_becomes_null(spark):
    assert C.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double")).where("v is null").count() == 1


def test_within_and_distance(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0))])
    got = spark.createDataFrame([(3.0, 1.0), (1.0, 3.0), (2.0, 2.0), (2.0, 0.0), (4.0, 4.0)], "x double, y double").select(G.strictly_within(F.col("x"), F.col("y"), ring)).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]
    d = lambda *v: spark.range(1).select(G.segment_distance2(*map(F.lit, v))).first()[0]
    assert d(0.0, 3.0, -1.0, 0.0, 1.0, 0.0) == 9 and d(5.0, 0.0, 0.0, 0.0, 2.0, 0.0) == 9 and d(1.0, 1.0, 0.0, 0.0, 0.0, 0.0) == 2


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-45.0, 0.0), (-44.0, -20.0), (-43.1, -19.3)], "lon double, lat double")
    x, y = G.to_utm(F.col("lon"), F.col("lat"))
    rows = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    assert tuple(rows.first()[2:]) == (500000.0, 10000000.0)
    lon, lat = G.from_utm(F.col("x"), F.col("y"))
    assert rows.agg(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()[0] < 1e-9


def test_distributions():
    assert D.chi2_sf(9.487729, 4) == pytest.approx(0.05, abs=1e-7)
    assert D.chi2_sf(3.0, 4) == pytest.approx(math.exp(-1.5) * 2.5)
    assert D.chi2_sf(30.0, 3) == pytest.approx(1.3801e-6, rel=1e-3)
    assert D.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-7)
    assert D.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert D.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-7)
    assert D.normal_cdf(D.normal_ppf(0.3)) == pytest.approx(0.3)
