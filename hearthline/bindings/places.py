"""Spatial queries: places from the embeddings, county boxes from the nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.bindings import tables as T
from hearthline.bindings.registry import query, rounded, rounded_sql
from hearthline.functions import geometry as G
from hearthline.operators import rollups, spatial
from hearthline.plans import components as K


def patches(spark, d):
    """A small box per place: its corner is the place, its width depends on the label."""
    width = F.lit(0.1) + F.col("label") * 0.05
    return T.points(spark, d).select(
        "fips", "label", "lon", "lat",
        G.box_rings(F.col("lon"), F.col("lat"), F.col("lon") + width, F.col("lat") + 0.1).alias("rings"),
    )


def label_county(column="label"):
    return T.county(F.col(column), F.lit(1))


PATCHES_SQL = """patches AS (SELECT fips, label, lon AS west, lat AS south, lon + (0.1 + label * 0.05) AS east, lat + 0.1 AS north FROM places)"""


def albers_sql(lon: str, lat: str) -> tuple[str, str]:
    """Equal-area metres in SQL with the constants of the projection."""
    e, e2 = G._E, G._E2
    sine = f"sin(radians({lat}))"
    q = f"({1 - e2!r}::DOUBLE * ({sine} / (1 - {e2!r}::DOUBLE * {sine} * {sine}) - ln((1 - {e!r}::DOUBLE * {sine}) / (1 + {e!r}::DOUBLE * {sine})) / {2 * e!r}::DOUBLE))"
    rho = f"({G._A!r}::DOUBLE * sqrt({G._C!r}::DOUBLE - {G._N!r}::DOUBLE * {q}) / {G._N!r}::DOUBLE)"
    theta = f"({G._N!r}::DOUBLE * radians({lon} + 96.0))"
    return f"{rho} * sin({theta})", f"{G._RHO0!r}::DOUBLE - {rho} * cos({theta})"


def corners_sql(source: str, name: str, keep: str) -> str:
    """Projected corners of the boxes of ``source`` in ring order."""
    parts = " UNION ALL ".join(
        f"SELECT {keep}, {i} AS i, {albers_sql(x, y)[0]} AS x, {albers_sql(x, y)[1]} AS y FROM {source}"
        for i, (x, y) in enumerate((("west", "south"), ("east", "south"), ("east", "north"), ("west", "north")))
    )
    return f"{name} AS ({parts})"


def area_sql(corners: str, name: str, keep: str) -> str:
    """Shoelace area relative to the first corner."""
    return f"""{name} AS (SELECT {keep}, abs(sum((a.x - o.x) * (b.y - o.y) - (b.x - o.x) * (a.y - o.y))) / 2 AS area FROM {corners} a JOIN {corners} b USING ({keep}) JOIN {corners} o USING ({keep})
        WHERE b.i = (a.i + 1) % 4 AND o.i = 0 GROUP BY {keep})"""


@query(
    "haversine_km",
    T.with_roles("places", "boxes") + rounded_sql(
        """SELECT p.fips, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(south - lat) / 2), 2) + cos(radians(lat)) * cos(radians(south)) * pow(sin(radians(west - lon) / 2), 2)))) AS km
        FROM places p JOIN boxes b ON b.fips = printf('%02d001', label + 1)""",
        "km",
    ),
)
def haversine(spark, d):
    corners = T.boxes(spark, d).select(F.col("fips").alias("county"), G.bounds_of(F.col("rings")).alias("box"))
    joined = T.points(spark, d).withColumn("county", label_county()).join(corners, "county")
    result = joined.select("fips", G.haversine_km(F.col("lat"), F.col("lon"), F.col("box.south"), F.col("box.west")).alias("km"))
    return rounded(result, "km")


_PATCH_AREA = ", ".join([PATCHES_SQL, corners_sql("patches", "patch_corner", "fips"), area_sql("patch_corner", "patch_area", "fips")])


@query("albers_area", T.with_roles("places") + ", " + _PATCH_AREA + rounded_sql("SELECT fips, area / 1e6 AS km2 FROM patch_area", "km2:5"))
def albers_area(spark, d):
    return rounded(patches(spark, d).select("fips", (G.albers_area(F.col("rings")) / 1e6).alias("km2")), "km2:5")


@query("repair_or_drop_geometry", "SELECT printf('%05d', vec_id) AS fips, 5::BIGINT AS n_points FROM embeddings WHERE label <> 0")
def repair_or_drop(spark, d):
    """Boxes of label 0 are flat, those of label 1 are not closed."""
    p = patches(spark, d)
    ring = F.element_at("rings", 1)
    flat = G.box_rings(F.col("lon"), F.col("lat"), F.col("lon") + 1.0, F.col("lat"))
    broken = p.withColumn(
        "rings", F.when(F.col("label") == 0, flat).when(F.col("label") == 1, F.array(F.slice(ring, 1, 4))).otherwise(F.col("rings"))
    )
    return spatial.repair_or_drop(broken).select("fips", F.size(F.element_at("rings", 1)).cast("long").alias("n_points"))


INSIDE_SQL = """inside AS (SELECT p.fips AS id, min(b.fips) AS county FROM places p JOIN boxes b ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY p.fips)"""


@query("point_in_polygon_join", T.with_roles("places", "boxes") + ", " + INSIDE_SQL + "\nSELECT * FROM inside")
def point_in_polygon(spark, d):
    points = T.points(spark, d).withColumnRenamed("fips", "id")
    boxes = T.boxes(spark, d).withColumnRenamed("fips", "county")
    return spatial.point_in_polygon(points, boxes, "id", "county")


_XY = albers_sql("lon", "lat")
NEAREST_SQL = ", ".join(
    [
        INSIDE_SQL,
        corners_sql("boxes", "box_corner", "fips"),
        "side AS (SELECT a.fips AS county, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM box_corner a JOIN box_corner b ON b.fips = a.fips AND b.i = (a.i + 1) % 4)",
        f"outer_point AS (SELECT fips AS id, {_XY[0]} AS x, {_XY[1]} AS y FROM places WHERE fips NOT IN (SELECT id FROM inside))",
        """gap AS (SELECT id, county, min(sqrt(pow(x1 + t * (x2 - x1) - x, 2) + pow(y1 + t * (y2 - y1) - y, 2))) AS distance_m FROM (
            SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM outer_point CROSS JOIN side) GROUP BY id, county)""",
        "nearest AS (SELECT id, arg_min(county, distance_m) AS county, min(distance_m) AS distance_m FROM gap GROUP BY id)",
    ]
)


@query("nearest_polygon_join", T.with_roles("places", "boxes") + ", " + NEAREST_SQL + rounded_sql("SELECT * FROM nearest", "distance_m:3"))
def nearest_polygon(spark, d):
    points = T.points(spark, d).withColumnRenamed("fips", "id")
    boxes = T.boxes(spark, d).withColumnRenamed("fips", "county")
    inside = spatial.point_in_polygon(points, boxes, "id", "county")
    outside = points.join(inside.select("id"), "id", "left_anti")
    return rounded(spatial.nearest_polygon(outside, boxes, "id", "county"), "distance_m:3")


def _mapped_sql(point: str, count: str, limit: str) -> str:
    return f""", located AS (SELECT id, county FROM inside UNION ALL SELECT id, county FROM nearest {limit})
    SELECT id AS {point}, county AS fips, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, count(*) OVER (PARTITION BY county) AS {count} FROM located JOIN places ON places.fips = id
    UNION ALL SELECT NULL, fips, NULL, NULL, 0 FROM boxes WHERE fips NOT IN (SELECT county FROM located)"""


@query("map_stations_to_counties", T.with_roles("places", "boxes") + ", " + NEAREST_SQL + _mapped_sql("station_id", "station_count", ""))
def stations(spark, d):
    points = T.points(spark, d).withColumnRenamed("fips", "station_id")
    return rounded(K.stations_to_counties(points, T.boxes(spark, d)), "lat lon")


@query("map_monitors_to_counties", T.with_roles("places", "boxes") + ", " + NEAREST_SQL + _mapped_sql("monitor_id", "monitor_count", "WHERE distance_m <= 50000"))
def monitors(spark, d):
    points = T.points(spark, d).withColumnRenamed("fips", "monitor_id")
    return rounded(K.monitors_to_counties(points, T.boxes(spark, d)), "lat lon")


TOUCH_SQL = """touch AS (SELECT DISTINCT p.label, b.fips AS county FROM patches p JOIN boxes b ON p.west <= b.east AND b.west <= p.east AND p.south <= b.north AND b.south <= p.north)"""


@query("polygon_intersects_join", T.with_roles("places", "boxes") + ", " + PATCHES_SQL + ", " + TOUCH_SQL + "\nSELECT * FROM touch")
def polygons_touching(spark, d):
    boxes = T.boxes(spark, d).withColumnRenamed("fips", "county")
    return spatial.polygons_touching(patches(spark, d), boxes, ["label"], "county")


_KNN_SQL = """pairs AS (SELECT a.fips, b.fips AS neighbour, b.value, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
    FROM places a JOIN places b ON a.label < 3 AND b.label >= 3),
    knn AS (SELECT * FROM pairs WHERE km <= 150 QUALIFY row_number() OVER (PARTITION BY fips ORDER BY km, neighbour) <= 8)"""


@query("range_distance_join", T.with_roles("places") + ", " + _KNN_SQL + rounded_sql("SELECT fips, neighbour, value, km FROM knn", "value km"))
def range_distance(spark, d):
    points = T.points(spark, d).withColumns({"layer": F.lit("all"), "max_km": F.lit(150.0)})
    found = spatial.nearest_neighbours(points.where("label < 3"), points.where("label >= 3"), ["layer"])
    return rounded(found.drop("layer"), "value km")


@query(
    "idw_estimates",
    T.with_roles("places") + ", " + _KNN_SQL + rounded_sql(
        "SELECT fips, coalesce(avg(value) FILTER (WHERE km = 0), sum(value / (km * km)) / sum(1 / (km * km))) AS estimate, min(km) AS nearest_km FROM knn GROUP BY fips", "estimate nearest_km"
    ),
)
def idw_estimates(spark, d):
    points = T.points(spark, d).withColumns({"layer": F.lit("all"), "max_km": F.lit(150.0)})
    found = spatial.nearest_neighbours(points.where("label < 3"), points.where("label >= 3"), ["layer"])
    return rounded(spatial.idw_estimates(found, ["layer"]).drop("layer"), "estimate nearest_km")


# --- plane rasters: degrees scaled to metres stand in for a projected grid ---------------------


def pixels(spark, d):
    return T.points(spark, d).select(
        (F.col("lon") * 100000.0).alias("x"), (F.col("lat") * 100000.0).alias("y"), F.col("label").alias("class")
    )


def plane_boxes(spark, d):
    edges = [c * 100000.0 for c in T.box_of_nation()]
    return T.table(spark, d, "nation").select(label_county("n_nationkey").alias("fips"), G.box_rings(*edges).alias("rings"))


PIXEL_SQL = """px AS (SELECT b.fips, label AS class FROM places p JOIN boxes b ON lon * 100000 BETWEEN west * 100000 AND east * 100000 AND lat * 100000 BETWEEN south * 100000 AND north * 100000)"""


@query("raster_polygon_join", T.with_roles("places", "boxes") + ", " + PIXEL_SQL + "\nSELECT fips, class, count(*) AS n FROM px GROUP BY ALL")
def raster_polygon(spark, d):
    located = K.pixels_in_counties(pixels(spark, d), plane_boxes(spark, d))
    return located.groupBy("fips", "class").agg(F.sum("n").alias("n"))


FIRE_SQL = """fire AS (SELECT concat(substr(fips, 1, 2), '001') AS fips, count(*) AS fire_event_count, sum(coalesce(property_damage, 0) + coalesce(crop_damage, 0)) AS fire_damage FROM storms WHERE event_type = 'R' AND year(date) BETWEEN 1996 AND 2000 GROUP BY ALL),
    activity AS (SELECT *, least(5.0, ln(1 + fire_damage) / ln(1 + (SELECT CASE WHEN quantile_cont(fire_damage, 0.95) > 0 THEN quantile_cont(fire_damage, 0.95) ELSE 1 END FROM fire)) * 5) AS wildfire_activity_score FROM fire),
    zonal AS (SELECT b.fips, avg(class) AS whp_mean, CAST(max(class) AS DOUBLE) AS whp_max, coalesce(count(*) FILTER (WHERE class >= 4) * 100.0 / nullif(count(class), 0), 0) AS pct_high_hazard FROM boxes b LEFT JOIN (SELECT * FROM px WHERE class BETWEEN 1 AND 5) USING (fips) GROUP BY b.fips)"""
_FIRE = "wildfire_score whp_mean pct_high_hazard fire_damage:2 wildfire_activity_score"


@query(
    "wildfire_scores",
    T.with_roles("places", "boxes", "storms") + ", " + PIXEL_SQL + ", " + FIRE_SQL + rounded_sql(
        """SELECT fips, CAST(2000 AS INTEGER) AS year, 0.7 * CASE WHEN whp_mean IS NULL THEN 0 ELSE 0.5 * whp_mean + 0.5 * 5 * pct_high_hazard / 100 END + 0.3 * coalesce(wildfire_activity_score, 0) AS wildfire_score, whp_mean, pct_high_hazard, whp_max,
        coalesce(fire_event_count, 0) AS fire_event_count, coalesce(fire_damage, 0) AS fire_damage, coalesce(wildfire_activity_score, 0) AS wildfire_activity_score FROM zonal LEFT JOIN activity USING (fips)""",
        _FIRE,
    ),
)
def wildfire(spark, d):
    events = T.storm_events(spark, d).withColumns(
        {
            "fips": F.concat(F.substring("fips", 1, 2), F.lit("001")),
            "event_type": F.when(F.col("event_type") == "R", "Wildfire").otherwise(F.col("event_type")),
        }
    )
    return rounded(K.wildfire(pixels(spark, d), plane_boxes(spark, d), 2000, events, planar=True), _FIRE)


# --- flood -----------------------------------------------------------------------------------


def zones(spark, d):
    label = F.col("label")
    return patches(spark, d).select(
        label_county().alias("county_fips"), "rings",
        F.when(label <= 2, "AE").when(label == 3, "X").otherwise("D").alias("flood_zone"),
        F.when(label == 3, "0.2 PCT ANNUAL CHANCE FLOOD HAZARD").alias("zone_subtype"),
    )


def block_groups(spark, d):
    return T.points(spark, d).select(
        F.format_string("%012d", F.col("fips").cast("long")).alias("block_group_fips"), label_county().alias("county_fips"),
        (F.col("fips").cast("double") + 1.0).alias("housing_units"), (F.col("lat") + 0.02).alias("lat"), (F.col("lon") + 0.02).alias("lon"),
    )


def map_panels(spark, d):
    orders = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    # Counties of the first five nations have panels without a date.
    dated = (F.col("o_totalprice") < 12000) & (F.col("c_nationkey") > 4)
    return orders.select(
        T.county(F.col("c_nationkey"), F.lit(1)).alias("county_fips"),
        F.when(dated, F.to_date("o_orderdate")).alias("effective_date"),
    )


_FLOOD_SQL = ", ".join(
    [
        _PATCH_AREA, corners_sql("boxes", "box_corner", "fips"), area_sql("box_corner", "box_area", "fips"),
        """exposure AS (SELECT fips, least(100, hi / area * 100) AS hi, least(100, mo / area * 100) AS mo FROM (SELECT printf('%02d001', label + 1) AS fips, coalesce(sum(area) FILTER (WHERE label <= 2), 0) AS hi, coalesce(sum(area) FILTER (WHERE label = 3), 0) AS mo
            FROM patches JOIN patch_area USING (fips) WHERE label <= 3 GROUP BY label) JOIN box_area USING (fips))""",
        """bg AS (SELECT printf('%02d001', label + 1) AS fips, CAST(fips AS DOUBLE) + 1 AS units, EXISTS (SELECT 1 FROM patches h WHERE h.label <= 2 AND p.lon + 0.02 BETWEEN h.west AND h.east AND p.lat + 0.02 BETWEEN h.south AND h.north) AS hit FROM places p)""",
        "share AS (SELECT fips, coalesce(sum(CASE WHEN hit THEN units ELSE 0 END) * 100.0 / sum(units), 0) AS pct_hu_high_risk FROM bg GROUP BY fips)",
        """newest AS (SELECT printf('%02d001', c_nationkey + 1) AS fips, max(CASE WHEN o_totalprice < 12000 AND c_nationkey > 4 THEN CAST(o_orderdate AS DATE) END) AS day FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)""",
    ]
)
_FLOOD = "flood_exposure pct_area_high_risk pct_area_moderate_risk pct_hu_high_risk"


@query(
    "flood_scores",
    T.with_roles("places", "boxes") + ", " + _FLOOD_SQL + rounded_sql(
        """SELECT fips, CAST(2010 AS INTEGER) AS year, 3 * hi + mo AS flood_exposure, hi AS pct_area_high_risk, mo AS pct_area_moderate_risk, pct_hu_high_risk, strftime(day, '%Y-%m-%d') AS nfhl_effective_date,
        CASE WHEN day >= DATE '2000-01-01' THEN 0 ELSE 1 END::INTEGER AS map_currency_flag FROM exposure LEFT JOIN share USING (fips) LEFT JOIN newest USING (fips)""",
        _FLOOD,
    ),
)
def flood(spark, d):
    result = K.flood_exposure(zones(spark, d), T.boxes(spark, d), 2010, block_groups(spark, d), map_panels(spark, d))
    return rounded(result, _FLOOD)


@query(
    "flood_result_assembly",
    T.with_roles("boxes") + """, newest AS (SELECT printf('%02d001', c_nationkey + 1) AS fips, max(CASE WHEN o_totalprice < 12000 THEN CAST(o_orderdate AS DATE) END) AS day, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)
    SELECT fips, CAST(2010 AS INTEGER) AS year, n::DOUBLE AS flood_exposure, 1.0::DOUBLE AS pct_area_high_risk, 2.0::DOUBLE AS pct_area_moderate_risk, CAST(NULL AS DOUBLE) AS pct_hu_high_risk,
    CASE WHEN fips >= '06001' THEN strftime(day, '%Y-%m-%d') END AS nfhl_effective_date, CASE WHEN fips >= '06001' AND day >= DATE '2000-01-01' THEN 0 ELSE 1 END::INTEGER AS map_currency_flag FROM newest""",
)
def flood_assembly(spark, d):
    exposure = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(
        T.county(F.col("c_nationkey"), F.lit(1)).alias("fips")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("flood_exposure"), F.first(F.lit(1.0)).alias("pct_area_high_risk"),
        F.first(F.lit(2.0)).alias("pct_area_moderate_risk"),
    )
    return K.assemble_flood(exposure, None, rollups.map_currency(map_panels(spark, d), 2010), 2010)


# --- air quality with plumes ---------------------------------------------------------------------


@query(
    "air_quality_with_plumes",
    T.with_roles("air_spikes", "places", "boxes") + ", " + PATCHES_SQL + ", " + TOUCH_SQL + """,
    hits AS (SELECT DATE '2024-01-05' + CAST(label AS INTEGER) AS date, county FROM touch),
    smoke AS (SELECT s.fips, s.year, s.date IN (SELECT DATE '2024-01-05' + CAST(label AS INTEGER) FROM patches) AS covered FROM air_spikes s
        WHERE daily_pm25 > 1.5 * pm25_baseline AND (s.date NOT IN (SELECT DATE '2024-01-05' + CAST(label AS INTEGER) FROM patches) OR EXISTS (SELECT 1 FROM hits h WHERE h.date = s.date AND h.county = s.fips))),
    counted AS (SELECT fips, year, count(*) AS n, count(*) FILTER (WHERE covered) AS a, count(*) FILTER (WHERE NOT covered) AS b FROM smoke GROUP BY ALL)"""
    + rounded_sql(
        """SELECT d.fips, d.year, avg(daily_pm25) AS pm25_annual_avg, count(*) FILTER (WHERE daily_aqi > 100) AS aqi_unhealthy_days, count(*) FILTER (WHERE daily_aqi > 150) AS aqi_very_unhealthy_days,
        coalesce(any_value(n), 0) AS smoke_days, CASE WHEN any_value(n) IS NULL OR any_value(a) > any_value(b) THEN 'hms' WHEN any_value(b) > any_value(a) THEN 'spike_detection' ELSE 'mixed' END AS smoke_day_method
        FROM air_daily d LEFT JOIN counted c ON c.fips = d.fips AND c.year = d.year GROUP BY d.fips, d.year""",
        "pm25_annual_avg",
    ),
)
def air_quality_with_plumes(spark, d):
    plumes = patches(spark, d).select(F.date_add(F.lit("2024-01-05").cast("date"), F.col("label").cast("int")).alias("date"), "rings")
    result = K.air_quality(T.readings(spark, d), T.monitor_map(spark, d), plumes, T.boxes(spark, d))
    return rounded(result, "pm25_annual_avg")
