"""Registry of the queries and of the SQL that each is held against.

Floating results are rounded alike on both sides, as sums differ in their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certamap.functions import certainty as C
from certamap.functions import geometry as G
from certamap.operators import autocorrelation as A
from certamap.operators import clusters as K
from certamap.operators import forest as X
from certamap.operators import ranks as T
from certamap.operators import regression as R
from certamap.operators import segments as S
from certamap.operators import spatial_joins as J
from certamap.operators.lineage import cut, fresh_path
from certamap.plans import fixtures as V
from certamap.sources import layers as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SCORES = ("lci", "mci", "pci", "gci")
FIELDS = ["cep", "lograd_num", "complemento", "dsc_localidade", "nv_geo_coord"]


def _duck(sql: str) -> str:
    return sql.format(**{t: t for t in ("orders", "nation", "supplier", "customer", "part", "region")})


_PRESENT = " + ".join(f"CASE WHEN {f} IS NOT NULL AND NOT regexp_full_match(CAST({f} AS VARCHAR), '\\s*') THEN {w} ELSE 0.0 END" for f, w in (("cep", 1.5), ("lograd_num", 1.5), ("complemento", 1.0), ("dsc_localidade", 0.5), ("nv_geo_coord", 0.5)))
#: Common table expressions that the statements below start with.
BASE = f"""
addr AS ({_duck(V.ADDR)}),
s0 AS (SELECT *,
  CAST(({_PRESENT}) AS DOUBLE) / 5.0 AS completude,
  CAST(CASE nv_geo_coord WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.5 WHEN 4 THEN 0.3 ELSE 0.1 END AS DOUBLE) AS lci,
  CASE WHEN match_distance IS NOT NULL AND textual_sim IS NOT NULL THEN CAST(0.5 AS DOUBLE) * least(greatest(textual_sim / 100.0, 0.0), 1.0) + CAST(0.5 AS DOUBLE) * least(greatest(1.0 - match_distance / 100.0, 0.0), 1.0) END AS mci,
  CAST(CASE WHEN coalesce(cod_tipo_especi = 103, false) OR coalesce(regexp_matches(complemento, '(?i)apartamento|edif[ií]cio|condom[ií]nio|bloco|sala|loja|andar|cobertura'), false) THEN 0.5 ELSE 1.0 END AS DOUBLE) AS pci,
  CASE cod_especie WHEN 1 THEN 'Domicílio Particular' WHEN 2 THEN 'Domicílio Coletivo' WHEN 3 THEN 'Estab. Agropecuário' WHEN 4 THEN 'Estab. Ensino' WHEN 5 THEN 'Estab. Saúde' WHEN 6 THEN 'Outras Finalidades' WHEN 7 THEN 'Em Construção' WHEN 8 THEN 'Estab. Religioso' ELSE 'Desconhecido' END AS especie_label,
  CASE cod_tipo_especi WHEN 101 THEN 'Casa' WHEN 102 THEN 'Casa de Vila/Condomínio' WHEN 103 THEN 'Apartamento' WHEN 104 THEN 'Outros' ELSE 'N/A' END AS tipo_resid_label,
  CASE nv_geo_coord WHEN 1 THEN 'Medido em campo' WHEN 2 THEN 'Estimado próximo' WHEN 3 THEN 'Estimado distante' WHEN 4 THEN 'Outro método' WHEN 6 THEN 'Sem medição' ELSE 'Desconhecido' END AS nv_geo_label,
  CASE WHEN cod_especie IN (1, 2) THEN 'Residencial' WHEN cod_especie = 3 THEN 'Agro' WHEN cod_especie IN (4, 5, 8) THEN 'Institucional' WHEN cod_especie = 6 THEN 'Comercial' ELSE 'Outros' END AS categoria
  FROM addr),
s AS (SELECT *, lci * mci * pci AS gci FROM s0),
cells AS ({_duck(V.CELLS)}),
pip AS (SELECT s.*, c.poly_id, c.n_name, c.n_regionkey, c.uso FROM s LEFT JOIN cells c ON s.x > c.x0 AND s.x < c.x1 AND s.y > c.y0 AND s.y < c.y1),
cls AS (SELECT *, CASE WHEN regexp_matches(upper(uso), 'RESID|DOMIC') THEN 'Residencial' WHEN regexp_matches(upper(uso), 'COMERC|SERV|MIST') THEN 'Comercial' WHEN regexp_matches(upper(uso), 'INST|PUBLI|EDUC|SAUDE') THEN 'Institucional' ELSE 'Outros' END AS uso_class FROM pip),
units AS (SELECT poly_id AS id, n_name, avg(gci) AS y, count(*) AS n FROM pip WHERE poly_id IS NOT NULL GROUP BY ALL),
corners AS (SELECT poly_id, unnest([{{'x': x0, 'y': y0}}, {{'x': x1, 'y': y0}}, {{'x': x1, 'y': y1}}, {{'x': x0, 'y': y1}}]) AS p FROM cells),
queen AS (SELECT DISTINCT a.poly_id AS i, b.poly_id AS j FROM corners a JOIN corners b ON a.p = b.p AND a.poly_id <> b.poly_id),
roads AS ({_duck(V.ROADS)}),
act AS ({_duck(V.ACTIVITY)}),
gold AS (SELECT *, CASE addr_id % 4 WHEN 0 THEN x + match_distance WHEN 1 THEN x - match_distance ELSE x + match_distance * 0 END AS gx,
  CASE addr_id % 4 WHEN 2 THEN y + match_distance WHEN 3 THEN y - match_distance / 2 ELSE y + match_distance * 0 END AS gy FROM s)
"""
ROAD_HITS = """
t AS (SELECT s.addr_id, r.rid, r.slope, r.road_class, s.x, s.y, r.x1, r.y1, r.x2, r.y2,
  least(1.0, greatest(0.0, ((s.x - r.x1) * (r.x2 - r.x1) + (s.y - r.y1) * (r.y2 - r.y1)) / ((r.x2 - r.x1) * (r.x2 - r.x1) + (r.y2 - r.y1) * (r.y2 - r.y1)))) AS t
  FROM s JOIN roads r ON s.x BETWEEN least(r.x1, r.x2) - {r} AND greatest(r.x1, r.x2) + {r} AND s.y BETWEEN least(r.y1, r.y2) - {r} AND greatest(r.y1, r.y2) + {r}),
d AS (SELECT addr_id, rid, slope, road_class, (x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1))) AS d2 FROM t),
hit AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY addr_id ORDER BY d2) AS r FROM d WHERE d2 <= {r} * {r}) WHERE r = 1)
"""
_ACT = "(s.x - a.x1) * (s.x - a.x1) + (s.y - a.y1) * (s.y - a.y1)"


def _normal_tail(z: str) -> str:
    """SQL for the two-sided tail of the normal distribution, by Simpson's rule."""
    h = f"(least({z}, 12.0) / 2000.0)"
    return f"greatest(0.0, 1 - 2 * (SELECT sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-(k * {h}) * (k * {h}) / 2)) * {h} / 3 FROM range(0, 2001) q(k)) / sqrt(2 * pi()))"


def _t_tail(t: str, v: str) -> str:
    """SQL for the two-sided tail of Student's distribution, by Simpson's rule."""
    h = f"(least({t}, 60.0) / 4000.0)"
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * (SELECT sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (k * {h}) * (k * {h}) / {v}, -({v} + 1) / 2.0)) * {h} / 3 FROM range(0, 4001) q(k)))"


def query(sql: str | None = None, more: str = "") -> Callable:
    """Register a query under its function's name, with its SQL over the common expressions."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {BASE}{',' + more if more else ''} {sql}"
        return f

    return put


def r6(c: str | Column, name: str | None = None, places: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, places).alias(name or c)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select([r6(c, c, places) if k == "double" else F.col(c) for c, k in df.dtypes])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.labels(C.score(V.addresses(spark, sf_dir))).withColumn("categoria", C.category(F.col("cod_especie")))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored addresses with the cell they are in."""
    return J.points_in_polygons(scored(spark, sf_dir), V.cells(spark, sf_dir), ["n_name", "n_regionkey", "uso"], 1000.0)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).where("poly_id is not null").groupBy(F.col("poly_id").alias("id"), "n_name").agg(F.avg("gci").alias("y"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ scores and labels


@query("SELECT addr_id, round(lci, 6) AS lci FROM s")
def lci_score(spark, sf_dir):
    return scored(spark, sf_dir).select("addr_id", r6("lci"))


@query("SELECT addr_id, round(completude, 6) AS completude FROM s")
def completeness_score(spark, sf_dir):
    return scored(spark, sf_dir).select("addr_id", r6("completude"))


@query("SELECT addr_id, round(mci, 6) AS mci FROM s")
def mci_score(spark, sf_dir):
    return scored(spark, sf_dir).select("addr_id", r6("mci"))


@query("SELECT addr_id, round(pci, 6) AS pci FROM s")
def pci_score(spark, sf_dir):
    return scored(spark, sf_dir).select("addr_id", r6("pci"))


@query("SELECT addr_id, round(gci, 6) AS gci FROM s")
def gci_score(spark, sf_dir):
    return scored(spark, sf_dir).select("addr_id", r6("gci"))


@query("SELECT addr_id, especie_label, tipo_resid_label, nv_geo_label FROM s")
def label_all(spark, sf_dir):
    return scored(spark, sf_dir).select("addr_id", "especie_label", "tipo_resid_label", "nv_geo_label")


@query("SELECT categoria, count(*) AS n FROM s GROUP BY 1")
def broad_category(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("categoria").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT addr_id, uso, uso_class FROM cls")
def landuse_keyword_class(spark, sf_dir):
    return placed(spark, sf_dir).select("addr_id", "uso", C.land_use_class(F.col("uso")).alias("uso_class"))


@query("SELECT addr_id, CAST(CASE WHEN cod_tipo_especi = 103 THEN 1 ELSE 0 END AS INT) AS is_vertical, CAST(match_distance IS NOT NULL AS INT) AS matched FROM s")
def flags(spark, sf_dir):
    df = V.addresses(spark, sf_dir)
    return df.select("addr_id", F.coalesce((F.col("cod_tipo_especi") == 103).cast("int"), F.lit(0)).alias("is_vertical"), F.col("match_distance").isNotNull().cast("int").alias("matched"))


@query("SELECT p_partkey, round(sim, 6) AS sim FROM lcs", more="""
txt AS (SELECT p_partkey, a IS NULL OR b IS NULL AS none, array_to_string(list_sort(list_filter(string_split_regex(lower(coalesce(a, '')), '\\s+'), lambda w: w <> '')), ' ') AS a,
  array_to_string(list_sort(list_filter(string_split_regex(lower(coalesce(b, '')), '\\s+'), lambda w: w <> '')), ' ') AS b FROM (""" + _duck(V.TEXTS) + """)),
dp(p_partkey, none, a, b, i, prow) AS (
  SELECT p_partkey, none, a, b, 0, list_transform(range(0, length(b) + 1), lambda k: 0) FROM txt
  UNION ALL
  SELECT p_partkey, none, a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN a[i + 1] = b[j] THEN prow[j] + 1 ELSE -1 END, prow[j + 1]]),
    lambda acc, v: list_append(acc, CASE WHEN v[1] >= 0 THEN v[1] ELSE greatest(v[2], acc[len(acc)]) END), [0]) FROM dp WHERE i < length(a)),
lcs AS (SELECT p_partkey, CASE WHEN none THEN 0.0 WHEN length(a) + length(b) = 0 THEN 100.0 ELSE 200.0 * prow[len(prow)] / (length(a) + length(b)) END AS sim FROM dp WHERE i = length(a))""")
def token_sort_similarity(spark, sf_dir):
    return V.view(spark, sf_dir, V.TEXTS).select("p_partkey", r6(C.text_similarity(F.col("a"), F.col("b")), "sim"))


# ------------------------------------------------------------------ segments

_A1 = """SELECT {k} AS segmento, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 6) AS pct, round(avg(lci), 6) AS lci_mean, round(avg(mci), 6) AS mci_mean, round(avg(pci), 6) AS pci_mean, round(avg(gci), 6) AS gci_mean,
 round(median(gci), 6) AS gci_median, round(stddev_samp(gci), 6) AS gci_std, round(sqrt(avg(match_distance * match_distance)), 6) AS rmse, round(quantile_cont(match_distance, 0.9), 6) AS ce90, round(avg(abs(match_distance)), 6) AS mae
 FROM s WHERE {k} IS NOT NULL GROUP BY 1"""


@query(_A1.format(k="nv_geo_label"))
def segment_metrics_nvgeo(spark, sf_dir):
    return rounded(S.metrics_by_segment(scored(spark, sf_dir), "nv_geo_label"))


@query(_A1.format(k="especie_label"))
def segment_metrics_especie(spark, sf_dir):
    return rounded(S.metrics_by_segment(scored(spark, sf_dir), "especie_label"))


@query(_A1.format(k="tipo_resid_label"))
def segment_metrics_tipo(spark, sf_dir):
    return rounded(S.metrics_by_segment(scored(spark, sf_dir), "tipo_resid_label"))


@query("SELECT round(sqrt(avg(match_distance * match_distance)), 6) AS rmse, round(quantile_cont(match_distance, 0.9), 6) AS ce90, round(avg(abs(match_distance)), 6) AS mae, round(median(match_distance), 6) AS median_error FROM s")
def error_summary(spark, sf_dir):
    d = F.col("match_distance")
    a = V.addresses(spark, sf_dir)
    places = S.quantiles(a, None, {"ce90": ("match_distance", 0.9), "median_error": ("match_distance", 0.5)}).first()
    means = a.agg(S.rmse(d).alias("rmse"), S.mae(d).alias("mae"))
    return rounded(means.select("rmse", F.lit(places["ce90"]).alias("ce90"), "mae", F.lit(places["median_error"]).alias("median_error")))


@query("SELECT c.n_name, round(m.completude, 9) AS completude, round(m.lci, 9) AS lci FROM cells c LEFT JOIN (SELECT n_name, avg(completude) AS completude, avg(lci) AS lci FROM pip WHERE n_name IS NOT NULL GROUP BY 1) m USING (n_name)")
def area_means(spark, sf_dir):
    means = placed(spark, sf_dir).where("n_name is not null").groupBy(F.col("n_name").alias("area")).agg(F.avg("completude").alias("completude"), F.avg("lci").alias("lci"))
    return rounded(V.cells(spark, sf_dir).join(means, F.col("n_name") == F.col("area"), "left").select("n_name", "completude", "lci"), 9)


@query("SELECT n_name, round(avg(gci), 6) AS mean, round(median(gci), 6) AS median, round(stddev_samp(gci), 6) AS std, count(gci) AS n FROM pip WHERE n_name IS NOT NULL GROUP BY 1")
def zone_stats(spark, sf_dir):
    p = placed(spark, sf_dir).where("n_name is not null")
    means = p.groupBy("n_name").agg(F.avg("gci").alias("mean"), F.stddev_samp("gci").alias("std"), F.count("gci").alias("n"))
    return rounded(means.join(S.quantiles(p, "n_name", {"median": ("gci", 0.5)}), "n_name", "left").select("n_name", "mean", "median", "std", "n"))


@query("SELECT n_name, round(avg(gci), 6) AS mean, count(*) AS n FROM pip WHERE n_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 50 ORDER BY n DESC, n_name LIMIT 20")
def zone_top20(spark, sf_dir):
    p = placed(spark, sf_dir).where("n_name is not null").groupBy("n_name").agg(F.avg("gci").alias("mean"), F.count(F.lit(1)).alias("n"))
    return rounded(p.where("n >= 50").orderBy(F.desc("n"), "n_name").limit(20))


@query("SELECT especie_label, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, especie_label LIMIT 8")
def value_counts_top8(spark, sf_dir):
    return S.value_counts(scored(spark, sf_dir), "especie_label", 8)


@query("SELECT uso, especie_label, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY uso), 6) AS share FROM pip WHERE uso IS NOT NULL GROUP BY 1, 2")
def crosstab_row_norm(spark, sf_dir):
    return rounded(S.crosstab_shares(placed(spark, sf_dir), "uso", "especie_label"))


_CM = """lab AS (SELECT unnest(['Residencial', 'Comercial', 'Institucional', 'Outros']) AS l),
cm AS (SELECT a.l AS row_label, b.l AS col_label, count(c.addr_id) AS n FROM lab a CROSS JOIN lab b LEFT JOIN cls c ON c.uso_class = a.l AND c.categoria = b.l GROUP BY 1, 2)"""


def _matrix(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("uso_class", C.land_use_class(F.col("uso")))
    return S.confusion(p, "uso_class", "categoria")


@query("SELECT row_label, col_label, n FROM cm", more=_CM)
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("row_label", "col_label", "n")


@query("SELECT row_label, col_label, round(100.0 * n / nullif(sum(n) OVER (PARTITION BY row_label), 0), 6) AS pct FROM cm", more=_CM)
def confusion_pct(spark, sf_dir):
    return rounded(_matrix(spark, sf_dir).select("row_label", "col_label", "pct"))


@query("SELECT round(100.0 * sum(CASE WHEN row_label = col_label THEN n ELSE 0 END) / sum(n), 6) AS agreement FROM cm", more=_CM)
def agreement_rate(spark, sf_dir):
    return rounded(S.agreement(_matrix(spark, sf_dir)))


@query("""SELECT n, round(100.0 * matched / n, 6) AS rate_joined, round(100.0 * points_matched / points, 6) AS rate, round(100.0 - 100.0 * points_matched / points, 6) AS unmatched FROM
 (SELECT count(*) AS n, count(rid) AS matched, count(DISTINCT addr_id) AS points, count(DISTINCT CASE WHEN rid IS NOT NULL THEN addr_id END) AS points_matched FROM j)""", more=f"""
near AS (SELECT s.addr_id, a.rid, rank() OVER (PARTITION BY s.addr_id ORDER BY {_ACT}) AS r FROM s JOIN act a ON a.x1 BETWEEN s.x - 50 AND s.x + 50 AND a.y1 BETWEEN s.y - 50 AND s.y + 50 WHERE s.cod_especie = 6 AND {_ACT} <= 2500),
j AS (SELECT s.addr_id, n.rid FROM s LEFT JOIN near n ON s.addr_id = n.addr_id AND n.r = 1 WHERE s.cod_especie = 6)""")
def functional_match_rate(spark, sf_dir):
    j = J.nearest(V.addresses(spark, sf_dir).where("cod_especie = 6"), V.activity(spark, sf_dir), 50.0, [])
    one = j.agg(F.count(F.lit(1)).alias("n"), F.count("rid").alias("m"), F.countDistinct("addr_id").alias("p"), F.countDistinct(F.when(F.col("rid").isNotNull(), F.col("addr_id"))).alias("pm"))
    rate = 100.0 * F.col("pm") / F.col("p")
    return rounded(one.select("n", (100.0 * F.col("m") / F.col("n")).alias("rate_joined"), rate.alias("rate"), (100.0 - rate).alias("unmatched")))


@query("SELECT p.addr_id, CAST(p.poly_id IS NOT NULL AS INT) AS in_cell, h.slope, t.poly_id AS tri FROM pip p LEFT JOIN hit h USING (addr_id) LEFT JOIN tri t USING (addr_id)", more=ROAD_HITS.format(r=30.0) + """,
tri AS (SELECT s.addr_id, r.r_regionkey AS poly_id FROM s JOIN region r ON s.y > 7790000 AND (s.y - 7790000) * 2000 < (s.x - (600000 + 4000 * r.r_regionkey)) * 25000 AND (s.y - 7790000) * 2000 < ((604000 + 4000 * r.r_regionkey) - s.x) * 25000)""")
def enrich_chain(spark, sf_dir):
    a = V.addresses(spark, sf_dir).select("addr_id", "x", "y")
    p = J.points_in_polygons(a, V.cells(spark, sf_dir), [], 1000.0).withColumn("in_cell", F.col("poly_id").isNotNull().cast("int")).drop("poly_id")
    p = J.nearest(p, V.roads(spark, sf_dir), 30.0, ["slope"]).drop("rid", "distance")
    return J.points_in_polygons(p, V.triangles(spark, sf_dir), [], 1000.0).select("addr_id", "in_cell", "slope", F.col("poly_id").alias("tri"))


_ENT = """hb AS (SELECT n_name, CASE WHEN gci >= 0.8 THEN 4 WHEN gci >= 0.6 THEN 3 WHEN gci >= 0.4 THEN 2 WHEN gci >= 0.2 THEN 1 ELSE 0 END AS b, count(*) AS n FROM pip WHERE n_name IS NOT NULL AND gci BETWEEN 0 AND 1 GROUP BY 1, 2),
ent AS (SELECT n_name, -sum(p * log2(p)) AS entropy FROM (SELECT n_name, n * 1.0 / sum(n) OVER (PARTITION BY n_name) AS p FROM hb) GROUP BY 1)"""


@query("SELECT n_name, round(entropy, 6) AS entropy FROM ent", more=_ENT)
def entropy_by_area(spark, sf_dir):
    return rounded(S.entropy_by(placed(spark, sf_dir), "n_name", "gci"))


@query("(SELECT 'top' AS side, n_name, round(entropy, 6) AS entropy FROM ent ORDER BY round(entropy, 6) DESC, n_name LIMIT 5) UNION ALL (SELECT 'bottom', n_name, round(entropy, 6) FROM ent ORDER BY round(entropy, 6), n_name LIMIT 5)", more=_ENT)
def entropy_extremes(spark, sf_dir):
    e = rounded(S.entropy_by(placed(spark, sf_dir), "n_name", "gci"))
    top, low = e.orderBy(F.desc("entropy"), "n_name").limit(5), e.orderBy("entropy", "n_name").limit(5)
    return top.select(F.lit("top").alias("side"), "n_name", "entropy").union(low.select(F.lit("bottom"), "n_name", "entropy"))


@query("""SELECT n_name, step, round(place, 6) AS place, round(sum(t * exp(-(place - v) * (place - v) / (2 * h * h))) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM vg JOIN vc USING (n_name) GROUP BY n_name, step, place""", more="""
vz AS (SELECT n_name, count(*) AS n, min(gci) AS lo, max(gci) AS hi, stddev_samp(gci) * pow(count(*), -0.2) AS h FROM pip WHERE n_name IN (SELECT n_name FROM (SELECT n_name, count(*) AS c FROM pip WHERE n_name IS NOT NULL GROUP BY 1 ORDER BY c DESC, n_name LIMIT 10)) AND gci IS NOT NULL GROUP BY 1),
vc AS (SELECT n_name, (floor(gci * 500) + 0.5) / 500 AS v, count(*) AS t FROM pip WHERE gci IS NOT NULL AND n_name IN (SELECT n_name FROM vz) GROUP BY 1, 2),
vg AS (SELECT *, CAST(k AS INT) AS step, lo + (hi - lo) * k / 20.0 AS place FROM vz, range(0, 21) r(k) WHERE h > 0)""")
def violin_density(spark, sf_dir):
    p = placed(spark, sf_dir).where("n_name is not null").select("n_name", "gci")
    return rounded(S.violin(p, "n_name", "gci"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) - count({f}) AS n_null, round(100.0 * count({f}) / count(*), 6) AS present_pct FROM s" for f in FIELDS))
def nullity_profile(spark, sf_dir):
    return rounded(S.nullity(V.addresses(spark, sf_dir), FIELDS))


@query("SELECT especie_label, " + ", ".join(f"round(avg(CASE WHEN {f} IS NOT NULL AND NOT regexp_full_match(CAST({f} AS VARCHAR), '\\s*') THEN 1.0 ELSE 0.0 END), 6) AS {f}" for f in FIELDS) + " FROM s GROUP BY 1")
def completeness_by_kind(spark, sf_dir):
    return rounded(scored(spark, sf_dir).groupBy("especie_label").agg(*[F.avg(C.present(F.col(f)).cast("double")).alias(f) for f in FIELDS]))


@query("SELECT nv_geo_label, count(*) AS n FROM s GROUP BY 1")
def method_counts(spark, sf_dir):
    return S.value_counts(scored(spark, sf_dir), "nv_geo_label")


@query("SELECT b.nv_geo_label, n, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(match_distance), 6) AS whisker_low, round(max(match_distance), 6) AS whisker_high FROM s JOIN b ON s.nv_geo_label = b.nv_geo_label WHERE match_distance BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL", more="""
b AS (SELECT nv_geo_label, count(*) AS n, quantile_cont(match_distance, 0.25) AS q1, quantile_cont(match_distance, 0.5) AS q2, quantile_cont(match_distance, 0.75) AS q3 FROM s WHERE match_distance IS NOT NULL GROUP BY 1)""")
def boxplot_stats(spark, sf_dir):
    return rounded(S.box_stats(scored(spark, sf_dir), "nv_geo_label", "match_distance"))


@query("SELECT especie_label, tipo_resid_label, count(*) AS n FROM s GROUP BY ROLLUP (especie_label, tipo_resid_label)")
def kind_rollup(spark, sf_dir):
    return scored(spark, sf_dir).rollup("especie_label", "tipo_resid_label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor(match_distance / 10.0) AS BIGINT) AS bin, count(*) AS n FROM s WHERE match_distance IS NOT NULL GROUP BY 1")
def error_histogram(spark, sf_dir):
    return S.histogram(V.addresses(spark, sf_dir), "match_distance", 10.0)


@query("SELECT addr_id FROM s ORDER BY md5(CAST(addr_id AS VARCHAR) || ':42'), addr_id LIMIT 1000")
def sample_n_seeded(spark, sf_dir):
    return S.sample_n(V.addresses(spark, sf_dir), 1000, 42, "addr_id").select("addr_id")


@query("SELECT addr_id, round(gci, 6) AS gci, segment FROM s WHERE gci < 0.3 AND segment IN (SELECT segment FROM s GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 2)")
def low_certainty_top_segments(spark, sf_dir):
    s = scored(spark, sf_dir)
    top = S.value_counts(s, "segment", 2).select("segment")
    return s.where("gci < 0.3").join(top, "segment", "left_semi").select("addr_id", r6("gci"), "segment")


# ------------------------------------------------------------------ spatial joins


@query("SELECT addr_id, poly_id, n_name FROM pip")
def pip_join_left(spark, sf_dir):
    return placed(spark, sf_dir).select("addr_id", "poly_id", "n_name")


@query("SELECT s.addr_id, h.rid, round(sqrt(h.d2), 6) AS distance FROM s LEFT JOIN hit h USING (addr_id)", more=ROAD_HITS.format(r=100.0))
def nearest_join_100m(spark, sf_dir):
    return J.nearest(V.addresses(spark, sf_dir), V.roads(spark, sf_dir), 100.0, []).select("addr_id", "rid", r6("distance"))


@query("SELECT road_class, count(*) AS n, round(avg(match_distance), 6) AS mean FROM (SELECT h.road_class, s.match_distance FROM s JOIN hit h USING (addr_id)) GROUP BY 1", more=ROAD_HITS.format(r=200.0))
def road_class_errors(spark, sf_dir):
    j = J.nearest(V.addresses(spark, sf_dir), V.roads(spark, sf_dir), 200.0, ["road_class"]).where("rid is not null")
    return rounded(j.groupBy("road_class").agg(F.count(F.lit(1)).alias("n"), F.avg("match_distance").alias("mean")))


#: Made-up street names of addresses, by id % 5, and of places, by id % 4.
STREETS = ("RUA DAS FLORES 10", "AV BRASIL NORTE", "RUA SETE DE MAIO", "TRAVESSA DO SOL", None)
PLACES = ("10 FLORES DAS RUA", "AVENIDA BRASIL NORTE", "RUA SETE DE MAIO SN", "BECO DO SOL")


def _name(id_col: str, names: tuple[str | None, ...]) -> str:
    return f"CASE {id_col} % {len(names)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names) if n) + " END"


@query("SELECT addr_id, rid, round(sim, 6) AS sim, round(mci, 6) AS mci FROM (SELECT *, row_number() OVER (PARTITION BY addr_id ORDER BY round(mci, 9) DESC, rid) AS r FROM best) WHERE r = 1", more=f"""
cand AS (SELECT s.addr_id, a.rid, sqrt({_ACT}) AS d, {_name('s.addr_id', STREETS)} AS ta, {_name('a.rid', PLACES)} AS tb FROM s JOIN act a ON a.x1 BETWEEN s.x - 100 AND s.x + 100 AND a.y1 BETWEEN s.y - 100 AND s.y + 100 WHERE {_ACT} <= 10000),
tx AS (SELECT ta, tb, array_to_string(list_sort(string_split(lower(ta), ' ')), ' ') AS a, array_to_string(list_sort(string_split(lower(tb), ' ')), ' ') AS b FROM (SELECT DISTINCT ta, tb FROM cand WHERE ta IS NOT NULL)),
dq(ta, tb, a, b, i, prow) AS (
  SELECT ta, tb, a, b, 0, list_transform(range(0, length(b) + 1), lambda k: 0) FROM tx
  UNION ALL
  SELECT ta, tb, a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN a[i + 1] = b[j] THEN prow[j] + 1 ELSE -1 END, prow[j + 1]]),
    lambda acc, v: list_append(acc, CASE WHEN v[1] >= 0 THEN v[1] ELSE greatest(v[2], acc[len(acc)]) END), [0]) FROM dq WHERE i < length(a)),
sm AS (SELECT ta, tb, 200.0 * prow[len(prow)] / (length(a) + length(b)) AS sim FROM dq WHERE i = length(a)),
best AS (SELECT addr_id, rid, sim, 0.5 * sim / 100.0 + 0.5 * greatest(0.0, 1 - d / 100.0) AS mci FROM cand JOIN sm USING (ta, tb) WHERE sim >= 80)""")
def radius_best_match(spark, sf_dir):
    """The best place within 100 m whose name is alike, by distance and similarity of names."""
    met = J.within_radius(V.addresses(spark, sf_dir), V.activity(spark, sf_dir), 100.0, [])
    met = met.withColumns({"ta": F.expr(_name("addr_id", STREETS)), "tb": F.expr(_name("rid", PLACES))})
    names = cut(met.where("ta is not null").select("ta", "tb").distinct())  # else the comparison is pushed below it, to every candidate
    alike = names.withColumn("sim", C.text_similarity(F.col("ta"), F.col("tb"))).where("sim >= 80")
    met = met.join(alike, ["ta", "tb"]).withColumn("mci", C.mci(F.sqrt("dist2"), F.col("sim")))
    best = met.groupBy("addr_id").agg(F.min(F.struct((-F.round("mci", 9)).alias("k"), "rid", "sim", "mci")).alias("b"))
    return best.select("addr_id", "b.rid", r6(F.col("b.sim"), "sim"), r6(F.col("b.mci"), "mci"))


@query("SELECT i, j, rank, round(dist, 6) AS dist FROM (SELECT a.rid AS i, b.rid AS j, sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1)) AS dist, CAST(row_number() OVER (PARTITION BY a.rid ORDER BY (a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1), b.rid) AS INT) AS rank FROM act a JOIN act b ON a.rid <> b.rid) WHERE rank <= 8")
def knn8_edges(spark, sf_dir):
    pts = V.activity(spark, sf_dir).select(F.col("rid").alias("addr_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    side = (20000.0 * 25000.0 * 4 / max(1, pts.count())) ** 0.5
    return J.k_nearest(pts, 8, side).select("i", "j", "rank", r6("dist"))


@query("SELECT i, j FROM queen")
def queen_edges(spark, sf_dir):
    return J.queen_edges(V.cells(spark, sf_dir))


# ------------------------------------------------------------------ spatial statistics

_Z = """m AS (SELECT avg(y) AS mean, count(*) AS n FROM units), z AS (SELECT id, y, y - mean AS z FROM units, m),
w AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM queen),
lag AS (SELECT z.id, z.z, (SELECT sum(w.w * zj.z) FROM w JOIN z zj ON zj.id = w.j WHERE w.i = z.id) AS lag, (SELECT sum(w.w) FROM w WHERE w.i = z.id) AS sw FROM z),
tot AS (SELECT sum(z * z) AS s2, sum(sw) AS s0, count(*) AS n, sum(z * lag) AS top FROM lag)"""


@query("SELECT n, round(s0, 6) AS s0, round(n / s0 * top / s2, 6) AS moran_i, (SELECT (least(count(*), 999 - count(*)) + 1) / 1000.0 FROM sm, tot WHERE round(s * tot.n / s0 / s2, 9) >= round(tot.n / s0 * top / s2, 9)) AS p_sim FROM tot", more=_Z + """,
ra AS (SELECT r, id, z, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || id), id) AS t, row_number() OVER (PARTITION BY r ORDER BY id) AS f FROM z, range(1, 1000) x(r)),
va AS (SELECT a.r, a.id, b.z FROM ra a JOIN ra b ON a.r = b.r AND b.f = a.t),
sm AS (SELECT a.r, sum(w.w * a.z * b.z) AS s FROM va a JOIN w ON w.i = a.id JOIN va b ON b.r = a.r AND b.id = w.j GROUP BY 1)""")
def moran_global(spark, sf_dir):
    return rounded(A.moran_global(cut(units(spark, sf_dir)), A.row_standardised(J.queen_edges(V.cells(spark, sf_dir))), "y", "id", A.PERMUTATIONS))


def sectors(spark, sf_dir):
    """Areas with ten addresses or more, with mean certainty, a missing one filled by the median of the others; and the row-standardised weights of those that touch."""
    means = placed(spark, sf_dir).where("poly_id is not null").groupBy(F.col("poly_id").alias("id")).agg(F.avg("gci").alias("y"), F.count(F.lit(1)).alias("n"))
    cells = V.cells(spark, sf_dir)
    own = cut(cells.select("poly_id", "ring").join(means, F.col("poly_id") == F.col("id"), "left").where(F.coalesce("n", F.lit(0)) >= 10).drop("id"))
    middle = own.agg(F.median("y")).first()[0]  # one value an area
    own = own.withColumn("y", F.coalesce("y", F.lit(middle).cast("double")))
    return own.select(F.col("poly_id").alias("id"), "y"), A.row_standardised(J.queen_edges(own))


_SECTORS = """sect AS (SELECT c.poly_id AS id, coalesce(u.y, (SELECT median(y) FROM units WHERE n >= 10)) AS y FROM cells c LEFT JOIN units u ON u.id = c.poly_id WHERE coalesce(u.n, 0) >= 10),
sq AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM queen WHERE i IN (SELECT id FROM sect) AND j IN (SELECT id FROM sect)),
zs AS (SELECT id, y - (SELECT avg(y) FROM sect) AS z, y FROM sect)"""
#: From src (id, v), wt (i, j, w: equal for a unit) and g (id, scale, own, k): how many of 999 conditional permutations are at least a unit's own.
_PERMUTED = """pos AS (SELECT id, v, row_number() OVER (ORDER BY id) - 1 AS at FROM src),
dr AS (SELECT r, idx, row_number() OVER (PARTITION BY r ORDER BY min(t)) AS s FROM (SELECT r, t, CAST('0x' || substr(md5('42:' || r || ':' || t), 1, 8) AS BIGINT) % ((SELECT count(*) FROM pos) - 1) AS idx FROM range(1, 1000) x(r), range(0, 200) y(t)) GROUP BY r, idx),
sims AS (SELECT g.id, d.r, any_value(g.scale) * sum(p.v) / any_value(g.k) AS sim, any_value(g.scale * g.own) AS own FROM g JOIN pos o ON o.id = g.id JOIN dr d ON d.s <= g.k JOIN pos p ON p.at = CASE WHEN d.idx < o.at THEN d.idx ELSE d.idx + 1 END GROUP BY g.id, d.r),
ps AS (SELECT id, (least(l, 999 - l) + 1) / 1000.0 AS p_sim FROM (SELECT id, count(*) FILTER (round(sim, 9) >= round(own, 9)) AS l FROM sims GROUP BY id))"""
_LISA = f"""{_SECTORS}, src AS (SELECT id, z AS v FROM zs),
g AS (SELECT a.id, any_value(a.z) AS scale, sum(w.w * b.z) AS own, count(*) AS k FROM zs a JOIN sq w ON w.i = a.id JOIN zs b ON b.id = w.j GROUP BY a.id), {_PERMUTED},
ll AS (SELECT zs.id, CASE WHEN g.own IS NULL THEN NULL WHEN zs.z > 0 AND g.own > 0 THEN 1 WHEN zs.z <= 0 AND g.own > 0 THEN 2 WHEN zs.z <= 0 THEN 3 ELSE 4 END AS q, p_sim FROM zs LEFT JOIN g ON g.id = zs.id LEFT JOIN ps ON ps.id = zs.id),
la AS (SELECT *, CASE WHEN p_sim < 0.05 THEN CASE q WHEN 1 THEN 'High-High' WHEN 2 THEN 'Low-High' WHEN 3 THEN 'Low-Low' WHEN 4 THEN 'High-Low' ELSE 'NS' END ELSE 'NS' END AS lisa_label FROM ll)"""


@query("SELECT id, CAST(q AS INT) AS q, p_sim, lisa_label FROM la", more=_LISA)
def lisa_labels(spark, sf_dir):
    own, weights = sectors(spark, sf_dir)
    return A.lisa(own, weights, "y", "id").select("id", "q", r6("p_sim"), "lisa_label")


_NAMES = ["High-High", "Low-Low", "High-Low", "Low-High", "NS"]


@query("SELECT label, count(la.id) AS n, round(100.0 * count(la.id) / (SELECT count(*) FROM la), 6) AS pct FROM (SELECT unnest(['High-High', 'Low-Low', 'High-Low', 'Low-High', 'NS']) AS label) LEFT JOIN la ON la.lisa_label = label GROUP BY 1", more=_LISA)
def lisa_label_counts(spark, sf_dir):
    own, weights = sectors(spark, sf_dir)
    return rounded(A.label_counts(A.lisa(own, weights, "y", "id"), "lisa_label", _NAMES))


_SPOTS = f"""{_SECTORS}, src AS (SELECT id, y AS v FROM sect),
g AS (SELECT a.id, 1.0 AS scale, sum(w.w * b.y) AS own, count(*) AS k FROM sect a JOIN sq w ON w.i = a.id JOIN sect b ON b.id = w.j GROUP BY a.id), {_PERMUTED},
kk AS (SELECT count(*) * 1.0 AS n, sum(y) AS t, sum(y * y) AS qq FROM sect),
sp AS (SELECT s.id, (own - (t - y) / (n - 1)) / (sqrt((qq - y * y) / (n - 1) - (t - y) / (n - 1) * (t - y) / (n - 1)) * sqrt(((n - 1) / k - 1) / (n - 2))) AS z, p_sim FROM kk, sect s LEFT JOIN g ON g.id = s.id LEFT JOIN ps ON ps.id = s.id),
sc AS (SELECT *, CASE WHEN z > 1.96 THEN 'hot' WHEN z < -1.96 THEN 'cold' ELSE 'none' END AS spot FROM sp)"""


@query("SELECT id, round(z, 5) AS z, p_sim, spot FROM sc", more=_SPOTS)
def gi_hot_cold(spark, sf_dir):
    own, weights = sectors(spark, sf_dir)
    return A.spots(own, weights, "y", "id").select("id", r6("z", places=5), r6("p_sim"), "spot")


@query("SELECT label, count(sc.id) AS n FROM (SELECT unnest(['hot', 'cold', 'none']) AS label) LEFT JOIN sc ON sc.spot = label GROUP BY 1", more=_SPOTS)
def gi_spot_counts(spark, sf_dir):
    own, weights = sectors(spark, sf_dir)
    return A.label_counts(A.spots(own, weights, "y", "id"), "spot", ["hot", "cold", "none"]).select("label", "n")


@query("SELECT id, round((tot.n - 1) * z * lag / s2, 6) AS local_i, CAST(CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS INT) AS q FROM lag, tot", more=_Z)
def moran_local_quadrants(spark, sf_dir):
    return A.moran_local(units(spark, sf_dir), A.row_standardised(J.queen_edges(V.cells(spark, sf_dir))), "y", "id").select("id", r6("local_i"), "q")


_G = """k AS (SELECT count(*) * 1.0 AS n, sum(y) AS t, sum(y * y) AS q FROM units),
g AS (SELECT u.id, u.y, (SELECT sum(v.y) FROM queen e JOIN units v ON v.id = e.j WHERE e.i = u.id) AS swy, (SELECT count(*) * 1.0 FROM queen e JOIN units v ON v.id = e.j WHERE e.i = u.id) AS w FROM units u)"""


@query("SELECT id, round((swy - w * (t - y) / (n - 1)) / (sqrt((q - y * y) / (n - 1) - (t - y) / (n - 1) * (t - y) / (n - 1)) * sqrt(((n - 1) * w - w * w) / (n - 2))), 5) AS z FROM g, k", more=_G)
def gi_z(spark, sf_dir):
    return rounded(A.getis_ord(units(spark, sf_dir), J.queen_edges(V.cells(spark, sf_dir)), "y", "id"), 5)


@query("SELECT id, round((swy + y - (w + 1) * t / n) / (sqrt(q / n - t / n * t / n) * sqrt((n * (w + 1) - (w + 1) * (w + 1)) / (n - 1))), 5) AS z FROM g, k", more=_G)
def gi_star_z(spark, sf_dir):
    return rounded(A.getis_ord(units(spark, sf_dir), J.queen_edges(V.cells(spark, sf_dir)), "y", "id", star=True), 5)


_CLUSTERS = """low AS (SELECT addr_id AS id, x, y, gci FROM s WHERE gci < 0.3),
near AS (SELECT a.id AS i, b.id AS j FROM low a JOIN low b ON b.x BETWEEN a.x - {e} AND a.x + {e} AND b.y BETWEEN a.y - {e} AND a.y + {e} AND a.id <> b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {e} * {e}),
core AS (SELECT i AS c FROM near GROUP BY 1 HAVING count(*) + 1 >= {m}),
ce AS (SELECT i, j FROM near WHERE i IN (SELECT c FROM core) AND j IN (SELECT c FROM core)),
reach(c, r) AS (SELECT c, c FROM core UNION SELECT ce.i, reach.r FROM reach JOIN ce ON ce.j = reach.c WHERE reach.r < ce.i),
root AS (SELECT c, min(r) AS root FROM reach GROUP BY 1),
bord AS (SELECT near.i, min(root.root) AS b FROM near JOIN root ON near.j = root.c GROUP BY 1),
lab AS (SELECT l.*, coalesce(r.root, b.b, -1) AS cluster, r.c IS NOT NULL AS core FROM low l LEFT JOIN root r ON l.id = r.c LEFT JOIN bord b ON b.i = l.id)"""


def _low(spark, sf_dir):
    return scored(spark, sf_dir).where("gci < 0.3").select("addr_id", "x", "y", "gci")


@query("SELECT l.id, coalesce(d.k, -1) AS cluster, core FROM lab l LEFT JOIN (SELECT cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS k FROM (SELECT DISTINCT cluster FROM lab WHERE cluster >= 0)) d ON d.cluster = l.cluster", more=_CLUSTERS.format(e=200, m=50))
def dbscan_clusters(spark, sf_dir):
    return K.dense_labels(K.dbscan(_low(spark, sf_dir), 200.0, 50))


@query("SELECT id, cluster, core FROM lab", more=_CLUSTERS.format(e=400, m=11))
def dbscan_sparse(spark, sf_dir):
    return K.dbscan(_low(spark, sf_dir), 400.0, 11)


@query("SELECT cluster, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(gci), 6) AS mean FROM lab WHERE cluster >= 0 GROUP BY 1 ORDER BY 1 LIMIT 10", more=_CLUSTERS.format(e=400, m=11))
def dbscan_summary(spark, sf_dir):
    low = _low(spark, sf_dir)
    got = K.cluster_summary(low, K.dbscan(low, 400.0, 11), "gci")
    return got.select("cluster", "n", r6("x", places=4), r6("y", places=4), r6("mean"))


@query("SELECT CAST(floor(sqrt(d2) / 250.0) AS INT) AS lag_bin, count(*) AS n, round(avg((ga - gb) * (ga - gb)) / 2, 6) AS gamma FROM pr WHERE d2 < 25000000 GROUP BY 1", more="""
smp AS (SELECT addr_id, x, y, gci FROM s WHERE gci IS NOT NULL ORDER BY md5(CAST(addr_id AS VARCHAR) || ':42'), addr_id LIMIT 3000),
pr AS (SELECT a.gci AS ga, b.gci AS gb, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM smp a JOIN smp b ON a.addr_id < b.addr_id)""")
def semivariogram(spark, sf_dir):
    smp = S.sample_n(scored(spark, sf_dir).where("gci is not null").select("addr_id", "x", "y", "gci"), 3000, 42, "addr_id")
    return rounded(K.semivariogram(smp, "gci", 250.0, 20))


@query("""SELECT round(reach, 6) AS range, round(b + c, 6) AS sill, round(b, 6) AS nugget FROM (SELECT reach, b, c, sum(n * (g - b - c * x) * (g - b - c * x)) AS err FROM fx JOIN co USING (reach) GROUP BY ALL) ORDER BY round(err, 6), reach LIMIT 1""", more="""
smp AS (SELECT addr_id, x, y, gci FROM s WHERE gci IS NOT NULL ORDER BY md5(CAST(addr_id AS VARCHAR) || ':42'), addr_id LIMIT 3000),
pr AS (SELECT a.gci AS ga, b.gci AS gb, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM smp a JOIN smp b ON a.addr_id < b.addr_id),
vb AS (SELECT floor(sqrt(d2) / 250.0) * 250.0 + 125.0 AS h, count(*) * 1.0 AS n, avg((ga - gb) * (ga - gb)) / 2 AS g FROM pr WHERE d2 < 25000000 GROUP BY 1),
fx AS (SELECT reach, n, g, CASE WHEN h <= reach THEN 1.5 * h / reach - 0.5 * pow(h / reach, 3) ELSE 1.0 END AS x FROM vb, (SELECT (SELECT max(h) FROM vb) * k / 200 AS reach FROM range(1, 241) r(k))),
su AS (SELECT reach, sum(n) AS sw, sum(n * x) AS sx, sum(n * g) AS sy, sum(n * x * x) AS sxx, sum(n * g * x) AS sxy FROM fx GROUP BY 1),
cc AS (SELECT *, CASE WHEN sw * sxx - sx * sx > 1e-12 THEN greatest(0.0, (sw * sxy - sx * sy) / (sw * sxx - sx * sx)) ELSE 0.0 END AS c FROM su),
co AS (SELECT reach, c, greatest(0.0, (sy - c * sx) / sw) AS b FROM cc)""")
def variogram_fit(spark, sf_dir):
    smp = S.sample_n(scored(spark, sf_dir).where("gci is not null").select("addr_id", "x", "y", "gci"), 3000, 42, "addr_id")
    return rounded(K.spherical_fit(K.semivariogram(smp, "gci", 250.0, 20), 250.0))


@query("SELECT count(*) AS n, round(2.0 * sum(i * gci) / (count(*) * sum(gci)) - (count(*) + 1.0) / count(*), 6) AS gini FROM (SELECT gci, row_number() OVER (ORDER BY gci) AS i FROM s WHERE gci IS NOT NULL)")
def gini(spark, sf_dir):
    return rounded(K.gini(scored(spark, sf_dir), "gci"))


@query("SELECT CAST(k AS INT) AS step, k / 10.0 AS share_of_rows, round(sum(gci * greatest(0.0, least(1.0, k * n / 10.0 - (i - 1)))) / max(t), 6) AS share_of_value FROM o, (SELECT unnest(range(1, 11)) AS k) GROUP BY k", more="""
o AS (SELECT gci, row_number() OVER (ORDER BY gci) AS i, count(*) OVER () AS n, sum(gci) OVER () AS t FROM s WHERE gci IS NOT NULL)""")
def lorenz_curve(spark, sf_dir):
    return rounded(K.lorenz(scored(spark, sf_dir), "gci"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS scale, count(m) AS n_areas, round(avg(m), 6) AS mean_of_means, round(stddev_samp(m) / avg(m), 6) AS cv FROM (SELECT {k}, avg(gci) AS m FROM pip WHERE {k} IS NOT NULL GROUP BY 1)" for k in ("n_name", "n_regionkey", "segment")))
def maup_scales(spark, sf_dir):
    return rounded(K.maup(placed(spark, sf_dir), ["n_name", "n_regionkey", "segment"], "gci"))


@query("SELECT n, round(atan2(ss, cc), 6) AS mean_direction, round(sqrt(rr) / n, 6) AS r_bar, round(rr / n, 4) AS z, round(least(1.0, exp(sqrt(1 + 4 * n + 4 * (n * n - rr)) - (1 + 2 * n))), 6) AS p_value FROM (SELECT *, cc * cc + ss * ss AS rr FROM (SELECT count(*) * 1.0::DOUBLE AS n, sum((gy - y) / l) AS cc, sum((gx - x) / l) AS ss FROM (SELECT *, sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y)) AS l FROM gold) WHERE l > 0))")
def rayleigh_stat(spark, sf_dir):
    got = K.rayleigh(V.gold(V.addresses(spark, sf_dir)))
    return got.select(F.col("n").cast("double").alias("n"), r6("mean_direction"), r6("r_bar"), r6("z", places=4), r6("p_value"))


@query("SELECT addr_id, x, y, round(gx, 6) AS gx, round(gy, 6) AS gy, round(sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y)), 6) AS len, round(atan2(gx - x, gy - y), 6) AS azimuth, round(gci, 6) AS metric FROM gold WHERE gx IS NOT NULL AND gy IS NOT NULL ORDER BY md5(CAST(addr_id AS VARCHAR) || ':42'), addr_id LIMIT 1000")
def spider_lines(spark, sf_dir):
    return rounded(K.spider_lines(V.gold(scored(spark, sf_dir)), "gci"))


@query("SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM s")
def total_bounds(spark, sf_dir):
    return V.addresses(spark, sf_dir).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query("""SELECT cu, cv, count(*) AS n, round(avg(gci), 9) AS mean FROM (SELECT gci, CASE WHEN d1 < d2 THEN floor(u + 0.5) ELSE floor(u) + 0.5 END AS cu, CASE WHEN d1 < d2 THEN floor(v + 0.5) ELSE floor(v) + 0.5 END AS cv
 FROM (SELECT gci, u, v, (u - floor(u + 0.5)) * (u - floor(u + 0.5)) + 3 * (v - floor(v + 0.5)) * (v - floor(v + 0.5)) AS d1, (u - floor(u) - 0.5) * (u - floor(u) - 0.5) + 3 * (v - floor(v) - 0.5) * (v - floor(v) - 0.5) AS d2 FROM hx)) GROUP BY 1, 2 HAVING count(*) >= 5""", more="""
bd AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM s WHERE gci IS NOT NULL), hx AS (SELECT gci, (x - x0) / ((x1 - x0) / 60.0) AS u, (y - y0) / ((y1 - y0) / 34.0) AS v FROM s, bd WHERE gci IS NOT NULL)""")
def hexbin_mean(spark, sf_dir):
    s = scored(spark, sf_dir).where("gci is not null").select("x", "y", "gci")
    x0, y0, x1, y1 = s.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    u, v = (F.col("x") - F.lit(x0)) / F.lit((x1 - x0) / 60.0), (F.col("y") - F.lit(y0)) / F.lit((y1 - y0) / 34.0)
    cu, cv = G.hex_cell(u, v)
    return s.groupBy(cu.alias("cu"), cv.alias("cv")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("gci"), "mean", 9)).where("n >= 5")


@query("""SELECT rid, round(6378137.0 * radians(lon), 3) AS wx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS wy FROM (SELECT rid, -44.0 + (rid % 100) / 1000.0 AS lon, -20.0 + (rid % 90) / 1000.0 AS lat FROM act)""")
def web_mercator(spark, sf_dir):
    lon, lat = -44.0 + (F.col("rid") % 100) / 1000.0, -20.0 + (F.col("rid") % 90) / 1000.0
    wx, wy = G.to_web(lon, lat)
    return V.activity(spark, sf_dir).select("rid", r6(wx, "wx", 3), r6(wy, "wy", 3))


@query("SELECT rid, round(-44.0 + (rid % 100) / 1000.0, 6) AS lon, round(-20.0 + (rid % 90) / 1000.0, 6) AS lat FROM act")
def utm_round_trip(spark, sf_dir):
    lon, lat = -44.0 + (F.col("rid") % 100) / 1000.0, -20.0 + (F.col("rid") % 90) / 1000.0
    x, y = G.to_utm(lon, lat)
    there = V.activity(spark, sf_dir).select("rid", x.alias("ux"), y.alias("uy"))
    back_lon, back_lat = G.from_utm(F.col("ux"), F.col("uy"))
    return there.select("rid", r6(back_lon, "lon"), r6(back_lat, "lat"))


@query("""SELECT c.ci, c.cj, c.n, round((SELECT sum(o.n * (1 - u) * (1 - u) * 3 / (pi() * 4000000.0)) FROM (SELECT o.n, ((o.ci - c.ci) * (o.ci - c.ci) + (o.cj - c.cj) * (o.cj - c.cj)) * 0.0625 AS u FROM dg o) o WHERE u < 1), 9) AS density FROM dg c""", more="""
dg AS (SELECT CAST(floor(x / 500.0) AS BIGINT) AS ci, CAST(floor(y / 500.0) AS BIGINT) AS cj, count(*) AS n FROM s GROUP BY 1, 2)""")
def density_surface(spark, sf_dir):
    return rounded(K.density_grid(V.addresses(spark, sf_dir), 500.0, 2000.0), 9)


# ------------------------------------------------------------------ tests and regressions


_KRUSKAL = """kr AS (SELECT segment, gci, rank() OVER (ORDER BY gci) + (count(*) OVER (PARTITION BY gci) - 1) / 2.0 AS rk FROM s WHERE gci IS NOT NULL),
kw AS (SELECT h, exp(-h / 2) * (1 + h / 2) AS p, k FROM (SELECT (12.0 / (n * (n + 1.0)) * sr - 3.0 * (n + 1)) / (1 - tt / (n * 1.0 * n * n - n)) AS h, k FROM
 (SELECT sum(g.n) AS n, sum(g.r * g.r / g.n) AS sr, count(*) AS k FROM (SELECT segment, count(*) AS n, sum(rk) AS r FROM kr GROUP BY 1) g), (SELECT sum(t * 1.0 * t * t - t) AS tt FROM (SELECT count(*) AS t FROM kr GROUP BY gci))))"""
_MANN = f"""mr AS (SELECT segment, match_distance, rank() OVER (ORDER BY match_distance) + (count(*) OVER (PARTITION BY match_distance) - 1) / 2.0 AS rk FROM s WHERE match_distance IS NOT NULL AND segment IN ('1-URGENT', '5-LOW')),
mz AS (SELECT *, greatest(0.0, (greatest(u, na * nb - u) - na * nb / 2.0 - 0.5) / sd) AS z FROM
 (SELECT ra - na * (na + 1) / 2.0 AS u, na, nb, ma, mb, sqrt(na * nb / 12.0 * ((na + nb + 1) - tt / ((na + nb) * (na + nb - 1.0)))) AS sd FROM (SELECT sum(rk) FILTER (segment = '1-URGENT') AS ra, count(*) FILTER (segment = '1-URGENT') AS na, count(*) FILTER (segment = '5-LOW') AS nb, avg(match_distance) FILTER (segment = '1-URGENT') AS ma, avg(match_distance) FILTER (segment = '5-LOW') AS mb FROM mr), (SELECT sum(t * 1.0 * t * t - t) AS tt FROM (SELECT count(*) AS t FROM mr GROUP BY match_distance)))),
mw AS (SELECT *, {_normal_tail("z")} AS p FROM mz)"""
_SPEARMAN = f"""sr AS (SELECT corr(ra, rb) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY gci) + (count(*) OVER (PARTITION BY gci) - 1) / 2.0 AS ra, rank() OVER (ORDER BY match_distance) + (count(*) OVER (PARTITION BY match_distance) - 1) / 2.0 AS rb FROM s WHERE gci IS NOT NULL AND match_distance IS NOT NULL)),
st AS (SELECT *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2.0 AS v FROM sr),
sp AS (SELECT *, {_t_tail("t", "v")} AS p FROM st)"""


@query("SELECT round(h, 6) AS h, round(p, 6) AS p_value, CAST(k AS BIGINT) AS n_groups FROM kw", more=_KRUSKAL)
def kruskal_h(spark, sf_dir):
    got = T.kruskal_wallis(scored(spark, sf_dir), "gci", "segment")
    return rounded(got.select("h", "p_value", "n_groups"))


@query("SELECT u, round(p, 6) AS p_value, round(z / sqrt(na + nb), 6) AS effect_size_r, na AS n_a, nb AS n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b FROM mw", more=_MANN)
def mann_whitney_u(spark, sf_dir):
    return rounded(T.mann_whitney(scored(spark, sf_dir), "match_distance", "segment", "1-URGENT", "5-LOW"))


@query("SELECT round(rho, 6) AS rho, round(p, 6) AS p_value, n FROM sp", more=_SPEARMAN)
def spearman_rho(spark, sf_dir):
    return rounded(T.spearman(scored(spark, sf_dir), "gci", "match_distance"))


_PC = ["completude", "lci", "mci", "pci", "gci", "match_distance"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM s" for i, a in enumerate(_PC) for b in _PC[:i]))
def pearson_matrix(spark, sf_dir):
    return rounded(R.pearson_matrix(scored(spark, sf_dir), _PC))


@query(f"SELECT variable, round(coef, 6) AS coef, round(e, 9) AS std_err, round({_t_tail('abs(coef / e)', 'v')}, 6) AS p_value, round(coef - q * e, 6) AS ci_low, round(coef + q * e, 6) AS ci_high FROM oq", more="""
om AS (SELECT regr_count(gci, match_distance) * 1.0::DOUBLE AS n, regr_avgx(gci, match_distance) AS mx, regr_sxx(gci, match_distance) AS sxx, regr_syy(gci, match_distance) AS syy, regr_slope(gci, match_distance) AS b, regr_intercept(gci, match_distance) AS a FROM s),
oe AS (SELECT *, n - 2 AS v, (syy - b * b * sxx) / (n - 2) AS s2, 1.959963984540054 AS z FROM om),
oc AS (SELECT 'const' AS variable, a AS coef, sqrt(s2 * (1 / n + mx * mx / sxx)) AS e, v, z FROM oe UNION ALL SELECT 'match_distance', b, sqrt(s2 / sxx), v, z FROM oe),
oq AS (SELECT *, z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * v * v * v) AS q FROM oc)""")
def ols_coefficients(spark, sf_dir):
    got = R.ols(scored(spark, sf_dir), "gci", ["match_distance"])[0]
    return got.select("variable", r6("coef"), r6("std_err", places=9), r6("p_value"), r6("ci_low"), r6("ci_high"))


@query("SELECT round(regr_slope(gci, textual_sim), 6) AS slope, round(regr_intercept(gci, textual_sim), 6) AS intercept, round(regr_r2(gci, textual_sim), 6) AS r2, regr_count(gci, textual_sim) AS n FROM s")
def regression_line(spark, sf_dir):
    return rounded(R.regression_line(scored(spark, sf_dir), "textual_sim", "gci"))


_STEPS = " + ".join(f"CASE WHEN u >= {math.exp(-1) * sum(1 / math.factorial(k) for k in range(m + 1))!r}::DOUBLE THEN 1 ELSE 0 END" for m in range(8))


@query("SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM bm", more=f"""
bu AS (SELECT rep, match_distance AS v, CAST('0x' || substr(md5(addr_id || ':' || rep), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS u FROM s, range(1, 201) r(rep) WHERE match_distance IS NOT NULL),
bm AS (SELECT rep, sum(w * v) / sum(w) AS m FROM (SELECT rep, v, {_STEPS} AS w FROM bu) GROUP BY 1)""")
def bootstrap_ci(spark, sf_dir):
    return rounded(K.bootstrap(V.addresses(spark, sf_dir), "match_distance", "addr_id"))


@query("SELECT round(p, 6) AS p, round(x, 6) AS sample, round(m + sd * z, 6) AS normal FROM (SELECT unnest(ps) AS p, unnest(zs) AS z, unnest(xs) AS x, m, sd FROM (SELECT [" + ", ".join(f"{k / 20!r}" for k in range(1, 20)) + "] AS ps, [" + ", ".join(f"{NormalDist().inv_cdf(k / 20)!r}" for k in range(1, 20)) + "] AS zs, quantile_cont(match_distance, [" + ", ".join(f"{k / 20!r}" for k in range(1, 20)) + "]) AS xs, avg(match_distance) AS m, stddev_samp(match_distance) AS sd FROM s WHERE match_distance IS NOT NULL))")
def qq_quantiles(spark, sf_dir):
    return rounded(K.qq(V.addresses(spark, sf_dir), "match_distance"))


_KNN = f"""kp AS (SELECT a.rid AS id, any_value(a.x1) AS x, any_value(a.y1) AS y, avg(s.gci) AS v FROM act a JOIN s ON s.cep = lpad(CAST(a.rid AS VARCHAR), 8, '0') GROUP BY 1 HAVING avg(s.gci) IS NOT NULL),
kn AS (SELECT i, j FROM (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r FROM kp a JOIN kp b ON a.id <> b.id) WHERE r <= 8),
zs AS (SELECT id, v - (SELECT avg(v) FROM kp) AS z FROM kp), src AS (SELECT id, z AS v FROM zs),
g AS (SELECT a.id, any_value(a.z) AS scale, sum(b.z) / count(*) AS own, count(*) AS k FROM zs a JOIN kn ON kn.i = a.id JOIN zs b ON b.id = kn.j GROUP BY a.id), {_PERMUTED}"""


@query("""SELECT id, round((n - 1) * scale * own / s2, 6) AS local_i, q, p_sim, CASE WHEN p_sim < 0.05 THEN CASE q WHEN 1 THEN 'High-High' WHEN 2 THEN 'Low-High' WHEN 3 THEN 'Low-Low' ELSE 'High-Low' END ELSE 'Not Significant' END AS lisa_cluster FROM
 (SELECT g.id, scale, own, p_sim, CAST(CASE WHEN scale > 0 AND own > 0 THEN 1 WHEN scale <= 0 AND own > 0 THEN 2 WHEN scale <= 0 THEN 3 ELSE 4 END AS INT) AS q FROM g JOIN ps ON ps.id = g.id), (SELECT count(*) AS n, sum(z * z) AS s2 FROM zs)""", more=_KNN)
def knn_lisa(spark, sf_dir):
    """Local Moran over the eight nearest of the places that have a mean certainty."""
    means = scored(spark, sf_dir).where("cep is not null").groupBy(F.col("cep").cast("long").alias("_r")).agg(F.avg("gci").alias("v")).where("v is not null")
    pts = cut(V.activity(spark, sf_dir).join(means, F.col("rid") == F.col("_r")).select(F.col("rid").alias("addr_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), "v"))
    near = J.k_nearest(pts, 8, (20000.0 * 25000.0 * 4 / max(1, pts.count())) ** 0.5)
    got = A.lisa(pts, cut(A.row_standardised(near.select("i", "j"))), "v", "addr_id", none="Not Significant")
    return got.select("id", r6("local_i"), "q", r6("p_sim"), F.col("lisa_label").alias("lisa_cluster"))


@query(None)
def gwr_local_r2(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("vertical", F.coalesce((F.col("cod_tipo_especi") == 103).cast("int"), F.lit(0)))
    return R.gwr(s, "gci", ["nv_geo_coord", "vertical"], neighbours=200)[0].select("id", "local_r2")


def _areas(spark, sf_dir):
    p = placed(spark, sf_dir).where("poly_id is not null")
    return p.groupBy(F.col("poly_id").alias("id")).agg(F.avg("gci").alias("gci"), F.avg("match_distance").alias("dist"), F.avg("completude").alias("comp"))


@query(None)
def sem_fit(spark, sf_dir):
    return R.spatial_error(_areas(spark, sf_dir), J.queen_edges(V.cells(spark, sf_dir)), "gci", ["dist", "comp"], "id")[0]


@query(None)
def model_comparison(spark, sf_dir):
    areas = cut(_areas(spark, sf_dir))
    sem = R.spatial_error(areas, J.queen_edges(V.cells(spark, sf_dir)), "gci", ["dist", "comp"], "id")[1]
    return R.compare_models(R.ols(areas, "gci", ["dist", "comp"])[1], sem)


#: Columns that a row of the five-feature forest has to have, and the features.
_COMPLETE = ["gci", "nv_geo_coord", "cod_especie", "cod_tipo_especi", "pci", "lci", "mci", "match_distance"]
_FIVE = ["nv_geo_coord", "cod_especie", "is_vertical", "lci", "mci"]


def _complete(spark, sf_dir):
    return scored(spark, sf_dir).dropna(subset=_COMPLETE).withColumn("is_vertical", (F.col("cod_tipo_especi") == 103).cast("int"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN cod_tipo_especi = 103 THEN 1.0 ELSE 0.0 END), 6) AS vertical, round(avg(gci), 6) AS gci, round(avg(lci), 6) AS lci, round(avg(mci), 6) AS mci FROM s WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _COMPLETE))
def rf_rows(spark, sf_dir):
    """The rows that the five-feature forest is made of."""
    rows = _complete(spark, sf_dir)
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("is_vertical").alias("vertical"), *[F.avg(c).alias(c) for c in ("gci", "lci", "mci")]))


@query(None)
def rf_importance(spark, sf_dir):
    rows = X.prepared(_complete(spark, sf_dir), "gci", _FIVE, "addr_id")
    return X.importance(X.fit(rows, _FIVE), rows, _FIVE)


@query(None)
def rf_permutation_importance(spark, sf_dir):
    rows = X.prepared(_complete(spark, sf_dir), "gci", _FIVE, "addr_id")
    return X.permutation_importance(X.fit(rows, _FIVE), rows, _FIVE)


@query(None)
def rf_shap_five(spark, sf_dir):
    """Mean absolute Shapley values of the five features over the first 5,000 of the sampled rows, which is how the analysis takes them."""
    rows = X.prepared(_complete(spark, sf_dir), "gci", _FIVE, "addr_id")
    return X.shapley_summary(X.shapley(X.fit(rows, _FIVE), rows, _FIVE, most=5000), _FIVE)


@query(None)
def rf_shap_summary(spark, sf_dir):
    p = J.nearest(placed(spark, sf_dir), V.roads(spark, sf_dir), 100.0, ["slope"], ties="first").withColumn("in_cell", F.col("poly_id").isNotNull().cast("int"))
    names = ["slope", "in_cell"]
    rows = X.prepared(p, "match_distance", names, "addr_id", fill=0.0)
    return X.shapley_summary(X.shapley(X.fit(rows, names, trees=50, depth=30), rows, names), names)


@query("""SELECT hypothesis, test, round(statistic, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS supported FROM (SELECT 'certainty differs between segments' AS hypothesis, 'kruskal' AS test, h AS statistic, p FROM kw
 UNION ALL SELECT 'error differs between first and last segment', 'mann_whitney', u, p FROM mw UNION ALL SELECT 'certainty falls with distance', 'spearman', rho, p FROM sp)""", more=f"{_KRUSKAL}, {_MANN}, {_SPEARMAN}")
def hypotheses(spark, sf_dir):
    """One row a hypothesis: its test, statistic, p-value and verdict."""
    s = cut(scored(spark, sf_dir).select("segment", "gci", "match_distance"))
    rows = []
    h = T.kruskal_wallis(s, "gci", "segment").first()
    rows.append(("certainty differs between segments", "kruskal", h["h"], h["p_value"]))
    m = T.mann_whitney(s, "match_distance", "segment", "1-URGENT", "5-LOW").first()
    rows.append(("error differs between first and last segment", "mann_whitney", m["u"], m["p_value"]))
    r = T.spearman(s, "gci", "match_distance").first()
    rows.append(("certainty falls with distance", "spearman", r["rho"], r["p_value"]))
    return rounded(spark.createDataFrame([(*x, x[3] is not None and x[3] < 0.05) for x in rows], "hypothesis string, test string, statistic double, p_value double, supported boolean"))


@query("SELECT addr_id, round(v, 6) AS v FROM (SELECT addr_id, coalesce(mci, (SELECT median(mci) FROM s)) AS v FROM s)")
def median_filled(spark, sf_dir):
    s = scored(spark, sf_dir)
    mid = S.quantiles(s, None, {"mid": ("mci", 0.5)}).first()[0]
    return s.select("addr_id", r6(F.coalesce("mci", F.lit(mid)), "v"))


@query("SELECT n_name, count(*) AS n, CAST(count(*) FILTER (gci < 0.3) AS BIGINT) AS low, round(count(*) FILTER (gci < 0.3) * 1.0 / sum(count(*) FILTER (gci < 0.3)) OVER (), 6) AS share FROM pip WHERE n_name IS NOT NULL GROUP BY 1")
def low_certainty_share(spark, sf_dir):
    p = placed(spark, sf_dir).where("n_name is not null").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gci") < 0.3).alias("low"))
    total = F.sum("low").over(Window.partitionBy(F.lit(0)))  # one row an area
    return p.select("n_name", "n", "low", r6(F.col("low") / total, "share"))


# ------------------------------------------------------------------ readers and writers


def _written(spark, df: DataFrame, form: str = "parquet") -> str:
    """The path of `df` as a file in the shared folder, for readers to read."""
    path = fresh_path(spark)
    if form == "csv":
        df.write.csv(path, header=True)
    else:
        L.write_stage(df, path)
    return path


@query("SELECT addr_id, x, y, match_distance FROM s")
def geoparquet_points(spark, sf_dir):
    """Points written as WKB and read back, all columns."""
    a = V.addresses(spark, sf_dir).select("addr_id", L.point_wkb("x", "y").alias("geometry"), F.coalesce("match_distance", F.lit(float("nan"))).alias("match_distance"))
    return L.read_points(spark, _written(spark, a)).select("addr_id", "x", "y", "match_distance")


@query("SELECT addr_id, cep FROM s")
def geoparquet_projection(spark, sf_dir):
    """Two columns of such a file, the others unread."""
    a = V.addresses(spark, sf_dir).withColumn("geometry", L.point_wkb("x", "y"))
    return L.read_points(spark, _written(spark, a), ["addr_id", "cep"])


@query("SELECT nv_geo_label, n FROM (SELECT nv_geo_label, count(*) AS n FROM s GROUP BY 1)")
def csv_results(spark, sf_dir):
    return L.read_results(spark, _written(spark, S.value_counts(scored(spark, sf_dir), "nv_geo_label"), "csv")).select("nv_geo_label", F.col("n").cast("long").alias("n"))


@query("SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def layer_views(spark, sf_dir):
    """Layers of a catalogue by name."""
    L.register(spark, {"layer_nation": f"{sf_dir}/nation.parquet", "layer_supplier": f"{sf_dir}/supplier.parquet"})
    return spark.sql("SELECT n_name, count(*) AS n FROM layer_nation JOIN layer_supplier ON s_nationkey = n_nationkey GROUP BY 1")


@query("SELECT addr_id, cod_especie FROM s WHERE CAST(cod_especie AS VARCHAR) = '3'")
def one_city(spark, sf_dir):
    """Raw rows of one code."""
    return L.filter_city(V.addresses(spark, sf_dir), "cod_especie", "3").select("addr_id", "cod_especie")
