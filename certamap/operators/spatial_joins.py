"""Spatial joins as equi-joins on grid cells.

Nothing is compared by a bare range predicate, which Spark would plan as a nested loop. Cells are columns of the join
key, so a crowded cell is a large join partition that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certamap.functions.geometry import segment_distance2, strictly_within
from certamap.operators.lineage import cut


def _cell(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(side))


def _cover(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, side: float, out: tuple[str, str]) -> DataFrame:
    """One row for every cell that the box meets."""
    df = df.withColumn(out[0], F.explode(F.sequence(_cell(x0, side), _cell(x1, side))))
    return df.withColumn(out[1], F.explode(F.sequence(_cell(y0, side), _cell(y1, side))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, attrs: list[str], side: float, ties: str = "all", id_col: str = "addr_id") -> DataFrame:
    """Left join: `points` (x, y) with `attrs` of the polygons (poly_id, ring) they are strictly inside.

    A point on a line is in no polygon, points in several are repeated (ties="first" keeps the smallest
    poly_id), points in none keep nulls. `side` is the cells' side, less than that of a usual polygon's box. A point
    lies in one cell, so one join does: points in a cell that no edge comes near are settled by the cell, others by their ring.
    """
    ring = F.col("ring")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    ends = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(F.least(a["x"], b["x"]).alias("x0"), F.greatest(a["x"], b["x"]).alias("x1"), F.least(a["y"], b["y"]).alias("y0"), F.greatest(a["y"], b["y"]).alias("y1")))
    box = _cover(polygons.select("poly_id", "ring", *attrs), F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys), side, ("_pi", "_pj"))
    left, low = F.col("_pi") * F.lit(side), F.col("_pj") * F.lit(side)
    met = F.exists(ends, lambda e: (e["x0"] <= left + side) & (e["x1"] >= left) & (e["y0"] <= low + side) & (e["y1"] >= low))
    middle = strictly_within(left + side / 2, low + side / 2, ring)
    box = box.withColumn("_met", met).where(F.col("_met") | middle).withColumn("_ring", F.when(F.col("_met"), ring)).drop("ring")
    inside = ~F.col("_met") | strictly_within(F.col("x"), F.col("y"), F.col("_ring"))
    if ties == "first":
        keyed = points.select(F.col(id_col).alias("_id"), "x", "y").withColumns({"_i": _cell(F.col("x"), side), "_j": _cell(F.col("y"), side)})
        hits = keyed.join(box, (F.col("_i") == F.col("_pi")) & (F.col("_j") == F.col("_pj")) & inside)
        best = hits.groupBy("_id").agg(F.min(F.struct("poly_id", *attrs)).alias("_hit")).select("_id", "_hit.*")
        return points.join(best, F.col(id_col) == F.col("_id"), "left").drop("_id")
    keyed = points.withColumns({"_i": _cell(F.col("x"), side), "_j": _cell(F.col("y"), side)})
    joined = keyed.join(box, (F.col("_i") == F.col("_pi")) & (F.col("_j") == F.col("_pj")) & inside, "left")
    return joined.drop("_i", "_j", "_pi", "_pj", "_met", "_ring")


def within_radius(points: DataFrame, segments: DataFrame, radius: float, attrs: list[str], id_col: str = "addr_id") -> DataFrame:
    """(id, rid, attrs, dist2): every segment (rid, x1, y1, x2, y2) within `radius`, which is included, of every point. A point layer has x2, y2 = x1, y1."""
    r = F.lit(radius)
    right = segments.select("rid", "x1", "y1", "x2", "y2", *attrs)
    right = _cover(right, F.least("x1", "x2") - r, F.greatest("x1", "x2") + r, F.least("y1", "y2") - r, F.greatest("y1", "y2") + r, radius, ("_ri", "_rj"))
    left = points.select(id_col, "x", "y").withColumns({"_i": _cell(F.col("x"), radius), "_j": _cell(F.col("y"), radius)})
    met = left.join(right, (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj")))
    met = met.withColumn("dist2", segment_distance2(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return met.where(F.col("dist2") <= radius * radius).select(id_col, "rid", *attrs, "dist2")


def nearest(points: DataFrame, segments: DataFrame, radius: float, attrs: list[str], ties: str = "all", id_col: str = "addr_id") -> DataFrame:
    """Left join: `points` with rid, `attrs` and distance of the nearest segment within `radius`; ties repeat the row, or ties="first" keeps the smallest rid."""
    met = within_radius(points, segments, radius, attrs, id_col)
    if ties == "first":
        best = met.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct("dist2", "rid", *attrs)).alias("_b")).select("_id", "_b.*")
    else:
        w = Window.partitionBy(id_col).orderBy("dist2")
        best = met.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r").withColumnRenamed(id_col, "_id")
    return points.join(best, F.col(id_col) == F.col("_id"), "left").withColumn("distance", F.sqrt("dist2")).drop("_id", "dist2")


def pairs_within(points: DataFrame, radius: float, id_col: str = "addr_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, d2, carried as a_*, b_*): every pair of points at most `radius` apart, once, i < j."""
    left = points.select(F.col(id_col).alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), *(F.col(c).alias(f"a_{c}") for c in carry))
    left = left.withColumns({"_i": _cell(F.col("ax"), radius), "_j": _cell(F.col("ay"), radius)})
    right = points.select(F.col(id_col).alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), *(F.col(c).alias(f"b_{c}") for c in carry))
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    right = right.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    right = right.withColumns({"_ri": _cell(F.col("bx"), radius) + F.col("_dx"), "_rj": _cell(F.col("by"), radius) + F.col("_dy")})
    met = left.join(right, (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj")) & (F.col("i") < F.col("j")))
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    return met.withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("i", "j", "d2", *(f"a_{c}" for c in carry), *(f"b_{c}" for c in carry))


def k_nearest(points: DataFrame, k: int, side: float, id_col: str = "addr_id") -> DataFrame:
    """(i, j, dist, rank): the k nearest other points of every point, ties by id. Rings of cells widen only for the points that are not settled.

    A round looks `reach` cells around; a point is settled when its kth distance is no longer than the ring is wide.
    """
    pts = cut(points.select(F.col(id_col).alias("id"), "x", "y"))
    total, out, reach = pts.count(), None, 1
    todo, most = pts, min(k, total - 1)
    if most < 1:
        return pts.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    while True:
        width = side * reach
        right = pts.select(F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
        right = right.withColumns({"_ri": _cell(F.col("bx"), width), "_rj": _cell(F.col("by"), width)})
        step = F.array(*[F.lit(s) for s in (-1, 0, 1)])
        left = todo.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
        left = left.withColumns({"_i": _cell(F.col("x"), width) + F.col("_dx"), "_j": _cell(F.col("y"), width) + F.col("_dy")})
        met = left.join(right, (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj")) & (F.col("id") != F.col("j")))
        dist = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
        near = met.select(F.col("id").alias("i"), "j", dist.alias("dist"))
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))).where(F.col("rank") <= k)
        near = cut(near)
        settled = near.groupBy("i").agg(F.count("*").alias("n"), F.max("dist").alias("far")).where((F.col("n") >= most) & (F.col("far") <= width)).select(F.col("i").alias("_s"))
        part = near.join(settled, F.col("i") == F.col("_s"), "left_semi")
        out = part if out is None else out.union(part)
        todo = cut(todo.join(settled, F.col("id") == F.col("_s"), "left_anti"))
        if todo.isEmpty():
            return out
        reach *= 2


def queen_edges(polygons: DataFrame) -> DataFrame:
    """(i, j) for polygons that share a vertex exactly, both ways round."""
    corners = polygons.select("poly_id", F.explode(F.array_distinct("ring")).alias("p")).select("poly_id", "p.x", "p.y")
    a, b = corners.toDF("i", "x", "y"), corners.toDF("j", "x", "y")
    return a.join(b, ["x", "y"]).where("i <> j").select("i", "j").distinct()
