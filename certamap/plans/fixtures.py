"""Views that make an address table and map layers out of the driver's tables. One SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADDR = """
SELECT o.o_orderkey AS addr_id,
  CAST(1 + o.o_orderkey % 9 AS INT) AS cod_especie,
  CASE WHEN o.o_orderkey % 9 = 0 THEN CAST(101 + o.o_custkey % 5 AS INT) END AS cod_tipo_especi,
  CASE WHEN o.o_orderkey % 37 = 0 THEN NULL WHEN substr(o.o_orderpriority,1,1)='5' THEN 6 ELSE CAST(substr(o.o_orderpriority,1,1) AS INT) END AS nv_geo_coord,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(o.o_custkey AS VARCHAR(20)), 8, '0') END AS cep,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_orderkey % 13 AS INT) END AS lograd_num,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'APARTAMENTO 12' WHEN 1 THEN 'EDIFÍCIO SOL' WHEN 2 THEN 'Bloco B' WHEN 3 THEN '   ' WHEN 4 THEN NULL WHEN 5 THEN 'FUNDOS' WHEN 6 THEN 'LOJAS' ELSE 'SALÃO' END AS complemento,
  CASE WHEN o.o_orderstatus='P' THEN '' ELSE o.o_orderstatus END AS dsc_localidade,
  CAST(600000 + (o.o_orderkey * 7919) % 20000 AS DOUBLE) AS x,
  CAST(7790000 + (o.o_orderkey * 104729) % 25000 AS DOUBLE) AS y,
  CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE CAST((o.o_orderkey * 31) % 1500 AS DOUBLE) / CAST(10 AS DOUBLE) END AS match_distance,
  CAST((o.o_orderkey * 17) % 101 AS DOUBLE) AS textual_sim,
  o.o_orderpriority AS segment
FROM {orders} o"""

CELLS = """
SELECT n_nationkey AS poly_id, n_name, n_regionkey,
  CASE n_nationkey % 5 WHEN 0 THEN 'RESIDENCIAL' WHEN 1 THEN 'COMERCIO E SERVICO' WHEN 2 THEN 'INSTITUCIONAL' WHEN 3 THEN 'MISTO' END AS uso,
  CAST(600000 + 4000 * (n_nationkey % 5) AS DOUBLE) AS x0, CAST(604000 + 4000 * (n_nationkey % 5) AS DOUBLE) AS x1,
  CAST(7790000 + 5000 * floor(n_nationkey / 5.0) AS DOUBLE) AS y0, CAST(7795000 + 5000 * floor(n_nationkey / 5.0) AS DOUBLE) AS y1
FROM {nation}"""

ROADS = """
SELECT s_suppkey AS rid, CAST(600000 + (s_suppkey * 1237) % 20000 AS DOUBLE) AS x1, CAST(7790000 + (s_suppkey * 3571) % 25000 AS DOUBLE) AS y1,
  CAST(600300 + (s_suppkey * 1237) % 20000 AS DOUBLE) AS x2, CAST(7790000 + (s_suppkey * 3571) % 25000 + ((s_suppkey % 7) - 3) * 100 AS DOUBLE) AS y2,
  CAST(s_suppkey % 30 AS DOUBLE) AS slope, CAST(s_suppkey % 4 AS INT) AS road_class
FROM {supplier}"""

ACTIVITY = """
SELECT c_custkey AS rid, CAST(600000 + (c_custkey * 6151) % 20000 AS DOUBLE) AS x1, CAST(7790000 + (c_custkey * 9973) % 25000 AS DOUBLE) AS y1 FROM {customer}"""

TEXTS = """
SELECT p_partkey, p_name || ' ' || p_brand AS a,
  CASE p_partkey % 4 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN p_name WHEN 2 THEN p_type || ' ' || p_name END AS b
FROM {part}"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in ("orders", "nation", "supplier", "customer", "part", "region") if f"{{{t}}}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ADDR)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles with rings."""
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    return view(spark, sf_dir, CELLS).withColumn("ring", ring)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    west = F.lit(600000.0) + 4000.0 * F.col("r_regionkey")
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    ring = F.array(corner(west, 7790000.0), corner(west + 4000, 7790000.0), corner(west + 2000, 7815000.0), corner(west, 7790000.0))
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("poly_id"), ring.alias("ring"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ROADS)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ACTIVITY).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})


def gold(df: DataFrame) -> DataFrame:
    """The matched point: displaced by the match distance, in one of four directions."""
    q, d = F.pmod("addr_id", F.lit(4)), F.col("match_distance")
    gx = F.when(q == 0, F.col("x") + d).when(q == 1, F.col("x") - d).otherwise(F.col("x") + d * 0)
    gy = F.when(q == 2, F.col("y") + d).when(q == 3, F.col("y") - d / 2).otherwise(F.col("y") + d * 0)
    return df.withColumns({"gx": gx, "gy": gy})
