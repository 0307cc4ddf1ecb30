"""Spatial operators against brute force, with shapes the SQL checks do not have."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hearthline.functions import geometry as G
from hearthline.operators import spatial
from hearthline.plans import components as K
from hearthline.plans import harmonize as H


def polygons(spark, shapes):
    rows = [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in shapes.items()]
    return spark.createDataFrame(rows, f"fips string, rings {G.RINGS_TYPE}")


def box(x, y, w=1.0, h=1.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def points(spark, places):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in places.items()], "id string, lon double, lat double")


def test_triangle_and_hole(spark):
    shapes = {"tri": [[(0, 0), (4, 0), (0, 4), (0, 0)]], "ring": [box(10, 0, 4, 4), box(11, 1, 2, 2)]}
    places = {"in": (1, 1), "beyond": (3, 3), "band": (10.5, 0.5), "hole": (12, 2), "none": (50, 50)}
    got = spatial.point_in_polygon(points(spark, places), polygons(spark, shapes), "id", "fips")
    assert {r.id: r.fips for r in got.collect()} == {"in": "tri", "band": "ring"}


def test_mixed_sizes_and_copies(spark):
    """A large polygon, tiny ones inside it, and copies under other ids."""
    shapes = {"big": [box(-100, 20, 60, 40)], "t1": [box(-90, 30, 1e-4, 1e-4)], "t0": [box(-90, 30, 1e-4, 1e-4)]}
    got = spatial.point_in_polygon(points(spark, {"p": (-89.99995, 30.00005), "q": (-50, 25)}), polygons(spark, shapes), "id", "fips")
    assert {r.id: r.fips for r in got.collect()} == {"p": "big", "q": "big"}
    small = spatial.point_in_polygon(points(spark, {"p": (-89.99995, 30.00005)}), polygons(spark, {k: shapes[k] for k in ("t0", "t1")}), "id", "fips")
    assert small.first().fips == "t0"


def test_intersections_match_box_overlap(spark):
    random.seed(2)
    make = lambda n, scale: {f"{i:02d}": [box(random.uniform(0, 20), random.uniform(0, 20), random.uniform(0.01, scale), random.uniform(0.01, scale))] for i in range(n)}
    left, right = make(30, 6), make(30, 1)
    overlap = lambda a, b: a[0][0][0] <= b[0][2][0] and b[0][0][0] <= a[0][2][0] and a[0][0][1] <= b[0][2][1] and b[0][0][1] <= a[0][2][1]
    want = {(i, j) for i, a in left.items() for j, b in right.items() if overlap(a, b)}
    got = spatial.polygons_touching(polygons(spark, left).withColumnRenamed("fips", "plume"), polygons(spark, right), ["plume"], "fips")
    assert {(r.plume, r.fips) for r in got.collect()} == want


def test_albers_area_of_a_degree(spark):
    """One degree box at the standard parallel, by the ellipsoidal zone formula."""
    got = polygons(spark, {"b": [box(-96, 40)]}).select(G.albers_area(F.col("rings"))).first()[0]
    # Fixed value: area between 40 and 41 degrees north, one degree wide, on GRS80.
    a, e2 = 6378137.0, 0.00669438002290
    e = math.sqrt(e2)
    q = lambda p: (1 - e2) * (math.sin(p) / (1 - e2 * math.sin(p) ** 2) - math.log((1 - e * math.sin(p)) / (1 + e * math.sin(p))) / (2 * e))
    zone = a * a / 2 * math.radians(1) * (q(math.radians(41)) - q(math.radians(40)))
    # Straight edges in the plane against curved parallels: a small difference remains.
    assert got == pytest.approx(zone, rel=2e-4)


def haversine(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("spread", ["even", "clustered", "dateline"])
def test_neighbours_match_brute_force(spark, spread):
    random.seed(11)
    def place(i):
        if spread == "clustered" and i % 3 == 0:
            return (-90.0, 40.0)
        if spread == "clustered" and i % 3 == 1:
            return (-90 + random.gauss(0, 0.01), 40 + random.gauss(0, 0.01))
        if spread == "dateline":
            return ((179.5 + random.uniform(0, 1.5) + 180) % 360 - 180, random.uniform(60, 70))
        return (random.uniform(-100, -80), random.uniform(30, 50))
    known = {f"s{i:03d}": (*place(i), float(i)) for i in range(120)}
    asked = {f"q{i:03d}": place(i + 1) for i in range(40)}
    sources = spark.createDataFrame([("l", k, x, y, v, 200.0) for k, (x, y, v) in known.items()], "layer string, fips string, lon double, lat double, value double, max_km double")
    queries = spark.createDataFrame([("l", k, x, y, 200.0) for k, (x, y) in asked.items()], "layer string, fips string, lon double, lat double, max_km double")
    got = {}
    for r in spatial.nearest_neighbours(queries, sources, ["layer"]).collect():
        got.setdefault(r.fips, []).append((round(r.km, 6), r.neighbour))
    for q, xy in asked.items():
        near = sorted((round(haversine(xy, s[:2]), 6), k) for k, s in known.items())
        want = [n for n in near if n[0] <= 200][:8]
        assert [km for km, _ in sorted(got.get(q, []))] == pytest.approx([km for km, _ in want])


def test_coincident_source_is_taken(spark):
    near = spark.createDataFrame([("l", "q", "a", 5.0, 0.0), ("l", "q", "b", 9.0, 10.0)], "layer string, fips string, neighbour string, value double, km double")
    assert spatial.idw_estimates(near, ["layer"]).first().estimate == 5.0


def test_monitor_limit_and_station_fallback(spark):
    counties = polygons(spark, {"01001": [box(-96, 38)], "01003": [box(-80, 38)]})
    places = spark.createDataFrame(
        [("in", -95.5, 38.5), ("near", -94.9, 38.5), ("far", -88.5, 38.5), ("lost", None, 1.0)], "station_id string, lon double, lat double"
    )
    stations = {r.station_id: (r.fips, r.station_count) for r in K.stations_to_counties(places, counties).collect()}
    # Stations take the nearest county at any distance.
    assert stations == {"in": ("01001", 3), "near": ("01001", 3), "far": ("01001", 3), None: ("01003", 0)}
    monitors = K.monitors_to_counties(places.withColumnRenamed("station_id", "monitor_id"), counties).collect()
    got = {r.monitor_id: (r.fips, r.monitor_count) for r in monitors}
    assert got == {"in": ("01001", 2), "near": ("01001", 2), None: ("01003", 0)}


def test_gap_fill_needs_a_tenth_of_the_counties(spark):
    rows = [(f"{i:05d}", 2020, 1.0 if i == 0 else None, float(i) if i < 5 else None) for i in range(20)]
    panel = spark.createDataFrame(rows, "fips string, year int, pm25_annual double, hdd_anomaly double")
    centres = spark.createDataFrame([(f"{i:05d}", 40.0, -90.0 + i * 0.1) for i in range(20)], "fips string, lat double, lon double")
    got = {r.fips: r for r in H.idw_gap_fill(panel, centres).collect()}
    assert got["00001"].pm25_annual is None and not got["00001"].pm25_annual__gap_filled
    assert got["00010"].hdd_anomaly is not None and got["00010"].hdd_anomaly__gap_filled
    assert got["00003"].hdd_anomaly == 3.0 and not got["00003"].hdd_anomaly__gap_filled


def test_wildfire_without_pixels_or_events(spark):
    counties = polygons(spark, {"01001": [box(0, 0, 10, 10)], "01003": [box(20, 0, 10, 10)]})
    pixels = spark.createDataFrame([(5.0, 5.0, 4), (6.0, 5.0, 2), (7.0, 5.0, 7)], "x double, y double, class int")
    got = {r.fips: r for r in K.wildfire(pixels, counties, 2024, planar=True).collect()}
    assert got["01001"].whp_mean == 3.0 and got["01001"].pct_high_hazard == 50.0
    assert got["01001"].wildfire_score == pytest.approx(0.7 * (0.5 * 3 + 0.5 * 2.5))
    assert got["01003"].whp_mean is None and got["01003"].wildfire_score == 0.0


def test_nearest_with_a_far_point_and_a_dense_cell(spark):
    """Many tiny polygons in one cell, large ones around, and points at every distance: equal to measuring all pairs."""
    random.seed(4)
    shapes = {f"d{i:03d}": [box(-95 + random.uniform(0, 0.02), 38 + random.uniform(0, 0.02), 2e-4, 2e-4)] for i in range(120)}
    shapes |= {f"l{i}": [box(-110 + 6 * i, 44, 3, 3)] for i in range(4)}
    places = {"far": (-158.0, 21.0), "other": (-66.0, 18.0), "dense": (-94.99, 38.01)}
    places |= {f"p{i:02d}": (random.uniform(-112, -85), random.uniform(36, 50)) for i in range(25)}
    areas = polygons(spark, shapes)
    got = spatial.nearest_polygon(points(spark, places), areas, "id", "fips").collect()
    x, y = G.albers_xy(F.col("lon"), F.col("lat"))
    planar = areas.select("fips", G.edges_of(G.albers_rings(F.col("rings"))).alias("e"))
    pairs = points(spark, places).select("id", x.alias("x"), y.alias("y")).crossJoin(planar)
    best = pairs.select("id", F.struct(G.distance_to_edges(F.col("e"), F.col("x"), F.col("y")).alias("d"), "fips").alias("b"))
    want = {r.id: r.b for r in best.groupBy("id").agg(F.min("b").alias("b")).collect()}
    assert {r.id: r.fips for r in got} == {k: b.fips for k, b in want.items()}
    assert all(r.distance_m == pytest.approx(want[r.id].d) for r in got)
    near = spatial.nearest_polygon(points(spark, places), areas, "id", "fips", 50_000.0).collect()
    assert {r.id for r in near} == {k for k, b in want.items() if b.d <= 50_000}
    assert spatial.nearest_polygon(points(spark, places), areas.limit(0), "id", "fips").count() == 0


def test_all_points_in_one_cell(spark, monkeypatch):
    """A crowded cell is dealt into shares without losing or repeating a row."""
    monkeypatch.setattr(spatial, "CROWD", 50)
    random.seed(5)
    shapes = {f"c{i}": [box(-90 + 0.1 * i, 40, 0.1, 0.1)] for i in range(3)}
    places = {f"p{i:04d}": (-90 + random.uniform(0, 0.3), 40.05) for i in range(600)}
    places |= {f"q{i}": (-89.95, 40.05) for i in range(300)}
    got = spatial.point_in_polygon(points(spark, places), polygons(spark, shapes), "id", "fips").collect()
    found = {r.id: r.fips for r in got}
    assert len(got) == len(found) == len(places)
    assert all(found[k] == f"c{min(2, int((x + 90) / 0.1))}" for k, (x, _) in places.items() if abs((x + 90) / 0.1 % 1) > 1e-6)
