"""Geometry on plain columns.

A polygon is ``array<array<struct<lon,lat>>>``: rings, the first one the shell.
An edge list is ``array<struct<x1,y1,x2,y2>>``; holes need no special care with
the even-odd rule.  All functions are Spark column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import params as P

RINGS_TYPE = "array<array<struct<lon:double,lat:double>>>"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2.0 * P.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def sphere_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Kilometre coordinates on the sphere; chords never exceed arcs."""
    phi, lam, r = F.radians(lat), F.radians(lon), P.EARTH_RADIUS_KM
    return r * F.cos(phi) * F.cos(lam), r * F.cos(phi) * F.sin(lam), r * F.sin(phi)


# GRS80 ellipsoid and the conterminous-US equal-area projection
# (EPSG:5070): parallels 29.5 and 45.5, origin 23 N 96 W.
_A = 6378137.0
_F = 1 / 298.257222101
_E2 = 2 * _F - _F * _F
_E = math.sqrt(_E2)
_PHI1, _PHI2, _PHI0, _LON0 = 29.5, 45.5, 23.0, -96.0


def _authalic(sin_phi, log):
    """Snyder's q for a sine of latitude; works on floats and on columns."""
    return (1 - _E2) * (sin_phi / (1 - _E2 * sin_phi * sin_phi) - log((1 - _E * sin_phi) / (1 + _E * sin_phi)) / (2 * _E))


def _albers_constants() -> tuple[float, float, float]:
    def q(deg):
        return _authalic(math.sin(math.radians(deg)), math.log)

    def m2(deg):
        s = math.sin(math.radians(deg))
        return math.cos(math.radians(deg)) ** 2 / (1 - _E2 * s * s)

    n = (m2(_PHI1) - m2(_PHI2)) / (q(_PHI2) - q(_PHI1))
    c = m2(_PHI1) + n * q(_PHI1)
    return n, c, _A * math.sqrt(c - n * q(_PHI0)) / n


_N, _C, _RHO0 = _albers_constants()


def albers_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal-area metres of a longitude/latitude point."""
    rho = _A * F.sqrt(F.lit(_C) - _N * _authalic(F.sin(F.radians(lat)), F.ln)) / _N
    theta = _N * F.radians(lon - _LON0)
    return rho * F.sin(theta), F.lit(_RHO0) - rho * F.cos(theta)


def albers_rings(rings: Column) -> Column:
    """Rings with points in equal-area metres (same field names, new meaning)."""

    def project(point):
        x, y = albers_xy(point["lon"], point["lat"])
        return F.struct(x.alias("lon"), y.alias("lat"))

    return F.transform(rings, lambda ring: F.transform(ring, project))


def box_rings(west: Column, south: Column, east: Column, north: Column) -> Column:
    """One closed rectangular ring."""
    corner = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    ring = F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))
    return F.array(ring)


def close_rings(rings: Column) -> Column:
    """Append the first point where a ring does not end on it."""

    def close(ring):
        first, last = F.element_at(ring, 1), F.element_at(ring, -1)
        return F.when((F.size(ring) > 0) & (first != last), F.concat(ring, F.array(first))).otherwise(ring)

    return F.transform(rings, close)


def _pairwise(ring: Column, combine) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), combine)


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area, taken relative to the first point for precision."""
    x0, y0 = F.get(ring, F.lit(0))["lon"], F.get(ring, F.lit(0))["lat"]
    parts = _pairwise(
        ring, lambda a, b: (a["lon"] - x0) * (b["lat"] - y0) - (b["lon"] - x0) * (a["lat"] - y0)
    )
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2.0


def polygon_area(rings: Column) -> Column:
    """Shell area minus hole areas, in the square of the point unit."""
    areas = F.transform(rings, ring_area)
    return 2.0 * F.element_at(areas, 1) - F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)


def albers_area(rings: Column) -> Column:
    """Equal-area square metres of a longitude/latitude polygon."""
    return polygon_area(albers_rings(rings))


def edges_of(rings: Column) -> Column:
    """All ring edges as one array."""
    edge = lambda a, b: F.struct(
        a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")
    )
    return F.flatten(F.transform(rings, lambda ring: _pairwise(ring, edge)))


def bounds_of(rings: Column) -> Column:
    """Bounding box struct ``west, south, east, north`` of the shell."""
    shell = F.element_at(rings, 1)
    lon = F.transform(shell, lambda p: p["lon"])
    lat = F.transform(shell, lambda p: p["lat"])
    return F.struct(
        F.array_min(lon).alias("west"), F.array_min(lat).alias("south"),
        F.array_max(lon).alias("east"), F.array_max(lat).alias("north"),
    )


def point_in(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with half-open edges and no division."""

    def crossing(e):
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
        up = (e["y1"] <= y) & (y < e["y2"]) & (turn > 0)
        down = (e["y2"] <= y) & (y < e["y1"]) & (turn < 0)
        return up | down

    return F.size(F.filter(edges, crossing)) % 2 == 1


def distance_to_edges(edges: Column, x: Column, y: Column) -> Column:
    """Smallest distance from a point to any edge."""

    def squared(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        ex, ey = e["x1"] + t * dx - x, e["y1"] + t * dy - y
        return ex * ex + ey * ey

    return F.sqrt(F.array_min(F.transform(edges, squared)))


def _cross(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def edges_touch(e: Column, f: Column) -> Column:
    """Two segments share a point (collinear overlap included through their boxes)."""
    d1 = _cross(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"])
    d2 = _cross(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"])
    d3 = _cross(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"])
    d4 = _cross(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"])
    boxes = (
        (F.least(e["x1"], e["x2"]) <= F.greatest(f["x1"], f["x2"]))
        & (F.least(f["x1"], f["x2"]) <= F.greatest(e["x1"], e["x2"]))
        & (F.least(e["y1"], e["y2"]) <= F.greatest(f["y1"], f["y2"]))
        & (F.least(f["y1"], f["y2"]) <= F.greatest(e["y1"], e["y2"]))
    )
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def polygons_intersect(edges_a: Column, edges_b: Column) -> Column:
    """Boundaries touch, or one polygon lies inside the other."""
    touch = F.exists(edges_a, lambda e: F.exists(edges_b, lambda f: edges_touch(e, f)))
    first = lambda edges: (F.get(edges, F.lit(0))["x1"], F.get(edges, F.lit(0))["y1"])
    return touch | point_in(edges_b, *first(edges_a)) | point_in(edges_a, *first(edges_b))


def valid_rings(rings: Column) -> Column:
    """Closed rings that enclose some area; an unusable shell gives an empty array."""
    usable = lambda ring: (F.size(ring) >= 4) & (ring_area(ring) > 0)
    closed = close_rings(rings)
    shell_ok = usable(F.element_at(closed, 1))
    return F.when((F.size(closed) > 0) & shell_ok, F.filter(closed, usable)).otherwise(F.slice(closed, F.lit(1), F.lit(0)))
