"""Plane geometry and map projections as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The GRS80 ellipsoid, and the transverse Mercator zone 23 south; the sphere of web maps.
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
UTM_MERIDIAN, UTM_SCALE, FALSE_EAST, FALSE_NORTH = -45.0, 0.9996, 500_000.0, 10_000_000.0
WEB_RADIUS = 6378137.0


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance from a point to a segment; a segment of no length is a point."""
    dx, dy = x2 - x1, y2 - y1
    long2 = dx * dx + dy * dy
    t = F.when(long2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - x1) * dx + (py - y1) * dy, long2))))
    qx, qy = px - (x1 + t * dx), py - (y1 + t * dy)
    return qx * qx + qy * qy


def strictly_within(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is inside a ring (array of struct x, y; closed or not) and not on its line."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def on(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
        return (cross == 0) & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crossed(e: Column) -> Column:
        return ((e["ay"] > py) != (e["by"] > py)) & (px < e["ax"] + F.try_divide((py - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"]))

    return ~F.exists(edges, on) & (F.size(F.filter(edges, crossed)) % 2 == 1)


def valid_ring(ring: Column) -> Column:
    """Closed, with four or more vertices, all finite."""
    finite = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return (F.size(ring) >= 4) & finite & (ring[0] == F.element_at(ring, -1))


def _krueger() -> tuple[float, float, list[float], list[float], list[float]]:
    n = GRS80_F / (2 - GRS80_F)
    a = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return n, a, alpha, beta, delta


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing from degrees, by the Krueger series."""
    n, a, alpha, _, _ = _krueger()
    k = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - UTM_MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + UTM_SCALE * a * x, FALSE_NORTH + UTM_SCALE * a * y


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees from easting and northing."""
    _, a, _, beta, delta = _krueger()
    xi, eta = (y - FALSE_NORTH) / (UTM_SCALE * a), (x - FALSE_EAST) / (UTM_SCALE * a)
    xi0, eta0 = xi, eta
    for j, c in enumerate(beta, 1):
        xi0 = xi0 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, c in enumerate(delta, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return UTM_MERIDIAN + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(phi)


def to_web(lon: Column, lat: Column) -> tuple[Column, Column]:
    return WEB_RADIUS * F.radians(lon), WEB_RADIUS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def hex_cell(u: Column, v: Column) -> tuple[Column, Column]:
    """Centre of the hexagon of a point in lattice units: the nearer of two offset lattices' centres."""
    i1, j1 = F.floor(u + 0.5).cast("double"), F.floor(v + 0.5).cast("double")
    i2, j2 = F.floor(u) + 0.5, F.floor(v) + 0.5
    first = (u - i1) * (u - i1) + 3 * (v - j1) * (v - j1) < (u - i2) * (u - i2) + 3 * (v - j2) * (v - j2)
    return F.when(first, i1).otherwise(i2), F.when(first, j1).otherwise(j2)
