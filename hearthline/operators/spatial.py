"""Spatial joins as equi-joins on grid cells followed by an exact test.

Polygons are ring arrays (see ``functions.geometry``).  A polygon is copied to
the few grid cells its bounding box covers on a level that fits its size, and
joined to the cells of points or other polygons; the exact predicate then
removes the false candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import geometry as G
from hearthline.storage import materialize


def repair_or_drop(polygons: DataFrame) -> DataFrame:
    """Close rings, drop degenerate ones, and drop polygons without a usable shell."""
    return polygons.withColumn("rings", G.valid_rings(F.col("rings"))).where(F.size("rings") > 0)


# Grid levels: level e has cells of side 4**e.  A box lies on the level just
# above its longer side, so it covers four cells at most, and a cell meets only
# boxes of about its own size.  Dense areas of small polygons get small cells.
DEGREES = (-9, 5)
METRES = (0, 13)
#: Levels of the projected plane: its coarsest cell and those beside it hold the whole plane.
PLANE = (2, 13)


def _cell(value: Column, size) -> Column:
    size = F.lit(float(size)) if isinstance(size, (int, float)) else size
    return F.floor(value / size).cast("long")


def _span(low: Column, high: Column, size, margin: float = 0.0) -> Column:
    return F.explode(F.sequence(_cell(low - margin, size), _cell(high + margin, size)))


def _boxed(polygons: DataFrame) -> DataFrame:
    """Polygons with their box and edge list in place of the rings."""
    return polygons.select(
        *[c for c in polygons.columns if c != "rings"],
        G.bounds_of(F.col("rings")).alias("_box"),
        G.edges_of(F.col("rings")).alias("_edges"),
    )


def _own_level(levels: tuple[int, int]) -> Column:
    side = F.greatest(F.col("_box.east") - F.col("_box.west"), F.col("_box.north") - F.col("_box.south"))
    fitting = F.ceil(F.log(F.greatest(side, F.lit(1e-12))) / F.log(F.lit(4.0)))
    return F.least(F.lit(levels[1]), F.greatest(F.lit(levels[0]), fitting)).cast("int")


def _side() -> Column:
    return F.pow(F.lit(4.0), F.col("_level"))


def _on_cells(boxed: DataFrame, size, margin: float = 0.0) -> DataFrame:
    """Rows copied to each grid cell of their (widened) box."""
    return boxed.withColumn("_cx", _span(F.col("_box.west"), F.col("_box.east"), size, margin)).withColumn(
        "_cy", _span(F.col("_box.south"), F.col("_box.north"), size, margin)
    )


def point_in_polygon(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, levels: tuple[int, int] = DEGREES
) -> DataFrame:
    """``(point_id, polygon_id)`` with the lowest polygon id of each contained point.

    ``points`` has ``lon`` and ``lat`` (or any x and y in the polygons' units).
    Copies of one polygon reduce to the lowest id before the join.
    """
    distinct = polygons.groupBy("rings").agg(F.min(polygon_id).alias(polygon_id))
    boxed = _boxed(distinct).withColumn("_level", _own_level(levels))
    cells = _on_cells(boxed, _side())
    placed = (
        points.dropna(subset=["lat", "lon"])
        .select(point_id, "lon", "lat")
        .withColumn("_levels", _occupied(boxed))
        .withColumn("_level", F.explode("_levels"))
        .drop("_levels")
        .withColumns({"_cx": _cell(F.col("lon"), _side()), "_cy": _cell(F.col("lat"), _side())})
    )
    x, y = F.col("lon"), F.col("lat")
    near = (x >= F.col("_box.west")) & (x <= F.col("_box.east")) & (y >= F.col("_box.south")) & (y <= F.col("_box.north"))
    hits = _crowd_join(placed, cells, [point_id, "lon", "lat"]).where(near).where(G.point_in(F.col("_edges"), x, y))
    return hits.groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id))


def _occupied(leveled: DataFrame, level: str = "_level") -> Column:
    """Levels that hold any row, as a scalar subquery: an array of at most a dozen numbers."""
    return leveled.agg(F.sort_array(F.collect_set(level)).alias("levels")).scalar()


_GRID = ["_level", "_cx", "_cy"]
#: Rows of one cell that one task may take in a join of points with polygons.
CROWD = 100_000


def _crowd_join(placed: DataFrame, cells: DataFrame, spread_by: list[str]) -> DataFrame:
    """Join on the cell, where cells with very many ``placed`` rows are dealt into shares.

    The rows of a crowded cell are spread over its shares by a hash of ``spread_by``, and the other side of such a
    cell is copied to each of them; all other cells have one share.
    """
    crowded = (
        placed.groupBy(*_GRID)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(CROWD)).cast("int").alias("_shares"))
        .where(F.col("_shares") > 1)
    )
    shares = F.coalesce("_shares", F.lit(1))
    dealt = placed.join(crowded, _GRID, "left").withColumn("_share", F.pmod(F.xxhash64(*spread_by), shares).cast("int"))
    copied = cells.join(crowded, _GRID, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return dealt.drop("_shares").join(copied.drop("_shares"), [*_GRID, "_share"]).drop("_share")


def nearest_polygon(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, limit_m: float | None = None
) -> DataFrame:
    """Nearest polygon of each point in the equal-area plane: ids and ``distance_m``.

    A pyramid over one border point of every polygon gives each point its own
    radius: on the finest level where the point's cell or one beside it holds
    such a border point, the nearest of them bounds the distance from above.
    Only polygons whose box lies within that bound are measured, so the search
    is exact at any distance and looks at small cells where polygons are dense.
    Points of one cell share its lookup.  ``limit_m`` drops points beyond it.
    """
    x, y = G.albers_xy(F.col("lon"), F.col("lat"))
    planar = materialize(_boxed(polygons.select(polygon_id, G.albers_rings(F.col("rings")).alias("rings"))), "planar")
    first, last = PLANE
    at = points.dropna(subset=["lat", "lon"]).select(point_id, x.alias("_x"), y.alias("_y"))
    at = at.withColumns({"_fx": _cell(F.col("_x"), 4.0**first), "_fy": _cell(F.col("_y"), 4.0**first)})

    # Cells with a border point in them or beside them, with one such point for each side it may come from.
    border = planar.where(F.size("_edges") > 0).select(
        F.col("_edges")[0]["x1"].alias("_px"), F.col("_edges")[0]["y1"].alias("_py")
    )
    one_each = (
        border.withColumn("_level", F.explode(F.sequence(F.lit(first), F.lit(last))))
        .withColumns({"_cx": _cell(F.col("_px"), _side()), "_cy": _cell(F.col("_py"), _side())})
        .groupBy(*_GRID)
        .agg(F.min(F.struct("_px", "_py")).alias("_sample"))
    )
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    beside = (
        one_each.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .select("_level", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"), "_sample")
        .groupBy(*_GRID)
        .agg(F.collect_list("_sample").alias("_samples"))
    )
    # A cell of a level lies in one cell of each level above, so its finest filled level is looked up once.
    asked = at.select("_fx", "_fy").distinct().withColumn("_level", F.explode(F.sequence(F.lit(first), F.lit(last))))
    up = F.pow(F.lit(4.0), F.col("_level") - F.lit(first))
    asked = asked.withColumns({"_cx": F.floor(F.col("_fx") / up).cast("long"), "_cy": F.floor(F.col("_fy") / up).cast("long")})
    nearest_level = asked.join(beside, _GRID).groupBy("_fx", "_fy").agg(F.min_by("_samples", "_level").alias("_samples"))
    reach = F.array_min(
        F.transform("_samples", lambda s: F.hypot(F.col("_x") - s["_px"], F.col("_y") - s["_py"]))
    )
    bound = F.least(reach, F.lit(float(limit_m))) if limit_m else reach
    # Widened by a hair, so that rounding cannot lose the polygon the bound comes from.
    bounded = at.join(nearest_level, ["_fx", "_fy"]).select(point_id, "_x", "_y", (bound * (1 + 1e-9) + 1e-6).alias("_reach"))
    fitting = F.ceil(F.log(F.col("_reach")) / F.log(F.lit(4.0))).cast("int")
    bounded = materialize(bounded.withColumn("_search", F.least(F.lit(last), F.greatest(F.lit(first), fitting))), "bounded")

    # A polygon waits on its own level and on those above that are searched; a point asks its search level for all
    # polygons up to that size, and each occupied level above for those of that size.
    sized = planar.select(polygon_id, "_box", _own_level(PLANE).alias("_own"))
    levels = F.array_union(_occupied(bounded, "_search"), F.array("_own"))
    homes = sized.withColumn("_levels", levels).withColumn("_level", F.explode("_levels")).where("_level >= _own").drop("_levels")
    homes = homes.withColumn("_cx", _span(F.col("_box.west"), F.col("_box.east"), _side(), _side()))
    homes = homes.withColumn("_cy", _span(F.col("_box.south"), F.col("_box.north"), _side(), _side()))
    sought = F.array_union(F.array("_search"), F.filter("_homes", lambda level: level > F.col("_search")))
    visits = bounded.withColumn("_homes", _occupied(sized, "_own")).withColumn("_level", F.explode(sought)).drop("_homes")
    visits = visits.withColumns({"_cx": _cell(F.col("_x"), _side()), "_cy": _cell(F.col("_y"), _side())})
    outside = lambda low, high, v: F.greatest(F.col(f"_box.{low}") - F.col(v), F.col(v) - F.col(f"_box.{high}"), F.lit(0.0))
    candidates = (
        _crowd_join(visits, homes, [point_id, "_x", "_y"])
        .where((F.col("_level") == F.col("_search")) | (F.col("_level") == F.col("_own")))
        .where(F.hypot(outside("west", "east", "_x"), outside("south", "north", "_y")) <= F.col("_reach"))
        .select(point_id, "_x", "_y", polygon_id, "_box")
    )
    distance = G.distance_to_edges(F.col("_edges"), F.col("_x"), F.col("_y"))
    measured = candidates.join(planar, [polygon_id, "_box"]).withColumn("distance_m", distance)
    measured = measured.where(F.col("distance_m") <= float(limit_m)) if limit_m else measured
    return (
        measured.groupBy(point_id)
        .agg(F.min(F.struct("distance_m", polygon_id)).alias("_best"))
        .select(point_id, f"_best.{polygon_id}", "_best.distance_m")
    )


def locate_points(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str = "fips",
    limit_m: float | None = None,
) -> DataFrame:
    """Containing polygon of each point, else the nearest one (within ``limit_m``)."""
    inside = materialize(point_in_polygon(points, polygons, point_id, polygon_id), "inside")
    outside = points.join(inside.select(point_id), point_id, "left_anti")
    nearest = nearest_polygon(outside, polygons, point_id, polygon_id, limit_m)
    return inside.unionByName(nearest.select(point_id, polygon_id))


def polygons_touching(
    left: DataFrame, right: DataFrame, left_id: list[str], right_id: str, levels: tuple[int, int] = DEGREES
) -> DataFrame:
    """Distinct ``(left_id..., right_id)`` of intersecting polygons.

    A pair meets on the level of the larger polygon: the smaller one is copied
    to the levels above its own, the larger one stays on its own level.
    """
    a = _boxed(left.select(*left_id, "rings")).withColumn("_own", _own_level(levels))
    b = _boxed(right.select(right_id, "rings")).withColumn("_own", _own_level(levels))

    def own(df):
        return _on_cells(df.withColumn("_level", F.col("_own")), _side())

    def above(df, first: int):
        raised = df.withColumn("_level", F.explode(F.sequence(F.col("_own"), F.lit(levels[1]))))
        return _on_cells(raised.where(F.col("_level") >= F.col("_own") + first), _side())

    def meet(p, q):
        p = p.withColumnsRenamed({"_edges": "_ea", "_box": "_ba"}).drop("_own")
        q = q.withColumnsRenamed({"_edges": "_eb", "_box": "_bb"}).drop("_own")
        overlap = (
            (F.col("_ba.west") <= F.col("_bb.east")) & (F.col("_bb.west") <= F.col("_ba.east"))
            & (F.col("_ba.south") <= F.col("_bb.north")) & (F.col("_bb.south") <= F.col("_ba.north"))
        )
        # Two boxes may share several cells; only the first shared one carries the test.
        corner = lambda axis, low: _cell(F.greatest(F.col(f"_ba.{low}"), F.col(f"_bb.{low}")), _side()) == F.col(axis)
        candidates = p.join(q, ["_level", "_cx", "_cy"]).where(overlap & corner("_cx", "west") & corner("_cy", "south"))
        return candidates.where(G.polygons_intersect(F.col("_ea"), F.col("_eb"))).select(*left_id, right_id)

    return meet(above(a, 0), own(b)).unionByName(meet(own(a), above(b, 1))).distinct()


_LEVELS = 11
#: Parts of rows that are about to be copied to 27 cells: few rows make many.
_PARTS = 64


def _leveled(df: DataFrame) -> DataFrame:
    """Rows copied to each grid level with their cell: level 0 is the coarsest."""
    return df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1)))).withColumns(
        {f"_c{a}": F.floor(F.col(f"_{a}") * F.pow(F.lit(2.0), F.col("_level")) / F.col("max_km")).cast("long") for a in "xyz"}
    )


def _around(df: DataFrame) -> DataFrame:
    """Rows copied to the 27 cells around their own."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for a in "xyz":
        df = df.withColumn("_d", F.explode(steps)).withColumn(f"_c{a}", F.col(f"_c{a}") + F.col("_d")).drop("_d")
    return df


def nearest_neighbours(
    queries: DataFrame, sources: DataFrame, keys: list[str], unit: str = "fips", k: int = P.IDW_NEIGHBOURS
) -> DataFrame:
    """The ``k`` nearest sources of each query within ``max_km``, by great circle.

    Both inputs have ``keys``, ``unit``, ``lat``, ``lon``, ``max_km`` (equal within
    a key); sources also ``value``.  Result: keys, unit, ``neighbour``, ``value``,
    ``km``.

    Points sit on a grid of the three sphere coordinates, so poles and the date
    line need no care.  A count pyramid tells for each query the finest level
    whose 27 cells hold more than ``k`` sources (one may be the query itself);
    two levels up, the 27 cells must contain the true ``k`` nearest, and only
    these are compared.  Dense areas thus look
    at small cells and sparse ones at large cells, and no cell is paired whole.
    Of sources at one spot only the ``k + 1`` lowest units can ever be chosen.
    """
    place = lambda df: df.withColumns(dict(zip(("_x", "_y", "_z"), G.sphere_xyz(F.col("lat"), F.col("lon")))))
    spot = Window.partitionBy(*keys, "lat", "lon").orderBy(unit)
    distinct_enough = (
        sources.withColumn("_place", F.row_number().over(spot)).where(F.col("_place") <= k + 1).drop("_place")
    )
    source_cells = _leveled(place(distinct_enough)).select(
        *keys, "_level", "_cx", "_cy", "_cz",
        F.col(unit).alias("neighbour"), F.col("lat").alias("_slat"), F.col("lon").alias("_slon"), "value",
    )
    cell = [*keys, "_level", "_cx", "_cy", "_cz"]
    counts = source_cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    asked = place(queries.select(*keys, unit, "lat", "lon", "max_km"))
    # Neighbourhoods are counted once per occupied cell; a query meets only its own cell of each level.
    own = _leveled(asked).select(*cell, unit)
    home = F.struct("_cx", "_cy", "_cz").alias("_home")
    around = _around(own.select(*cell).repartition(_PARTS, *cell).distinct().select("*", home))
    per_cell = around.join(counts, cell).groupBy(*keys, "_level", "_home").agg(F.sum("_n").alias("_n")).where(F.col("_n") > k)
    crowded = per_cell.select(*keys, "_level", "_home.*")
    level = own.join(crowded, cell).groupBy(*keys, unit).agg(F.greatest(F.lit(0), F.max("_level") - 2).alias("_level"))
    at_level = asked.join(level, [*keys, unit], "left").withColumn("_level", F.coalesce("_level", F.lit(0))).withColumns(
        {f"_c{a}": F.floor(F.col(f"_{a}") * F.pow(F.lit(2.0), F.col("_level")) / F.col("max_km")).cast("long") for a in "xyz"}
    )
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("_slat"), F.col("_slon"))
    candidates = (
        _around(at_level.repartition(_PARTS, *keys, unit))
        .join(source_cells, cell)
        .withColumn("km", km)
        .where(F.col("km") <= F.col("max_km"))
        .where(F.col("neighbour") != F.col(unit))
    )
    order = Window.partitionBy(*keys, unit).orderBy("km", "neighbour")
    return (
        candidates.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .select(*keys, unit, "neighbour", "value", "km")
    )


def idw_estimates(neighbours: DataFrame, keys: list[str], unit: str = "fips", power: float = P.IDW_POWER) -> DataFrame:
    """Inverse-distance mean of the neighbours and the distance of the nearest.

    A neighbour at distance zero leaves its weight undefined; such units take
    the mean of the coincident values.
    """
    weight = F.try_divide(F.lit(1.0), F.pow(F.col("km"), F.lit(power)))
    coincident = F.avg(F.when(F.col("km") == 0, F.col("value")))
    return neighbours.groupBy(*keys, unit).agg(
        F.coalesce(coincident, F.try_divide(F.sum(F.col("value") * weight), F.sum(weight))).alias("estimate"),
        F.min("km").alias("nearest_km"),
    )
