"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.bindings import tables as T
from hearthline.bindings.flow import _RATES_SQL
from hearthline.bindings.registry import query, rounded, rounded_sql
from hearthline.operators import clean, joins
from hearthline.plans import components as K


@query(
    "inner_equi_join",
    T.with_roles("obs", "stations") + "\nSELECT fips, date, count(*) AS n, max(tmax) AS hottest FROM obs JOIN stations USING (station_id) GROUP BY ALL",
)
def inner_equi_join(spark, d):
    joined = T.daily_obs(spark, d).join(T.station_map(spark, d), "station_id")
    return joined.groupBy("fips", "date").agg(F.count(F.lit(1)).alias("n"), F.max("tmax").alias("hottest"))


@query(
    "left_join",
    T.with_roles("station_year", "normal_year") + rounded_sql(
        "SELECT station_id, year, hdd_annual - normal_hdd_annual AS hdd_anomaly, cdd_annual - normal_cdd_annual AS cdd_anomaly FROM station_year LEFT JOIN normal_year USING (station_id)",
        "hdd_anomaly cdd_anomaly",
    ),
)
def left_join(spark, d):
    return rounded(_station_anomalies(spark, d).select("station_id", "year", "hdd_anomaly", "cdd_anomaly"), "hdd_anomaly cdd_anomaly")


def _station_anomalies(spark, d):
    from hearthline.functions import columns as C
    from hearthline.operators import rollups

    good = clean.filter_quality_flags(T.daily_obs(spark, d), ["tmax", "tmin"], ["q_flag_tmax", "q_flag_tmin"])
    tmax, tmin = F.col("tmax"), F.col("tmin")
    annual = rollups.annual_station_sums(
        good, {"hdd_annual": C.heating_degrees(tmax, tmin), "cdd_annual": C.cooling_degrees(tmax, tmin)}, T.MIN_OBS
    )
    return K.station_anomalies(annual, rollups.normal_annual(T.normals(spark, d)))


@query("inner_key_alignment", T.with_roles("housing", "census") + "\nSELECT h.fips, h.year, h.total_housing_units AS some, c.total_housing_units AS every FROM housing h JOIN census c USING (fips, year)")
def inner_key_alignment(spark, d):
    some = T.housing(spark, d).withColumnRenamed("total_housing_units", "some")
    every = T.census(spark, d).select("fips", "year", F.col("total_housing_units").alias("every"))
    return some.join(every, ["fips", "year"])


@query(
    "precedence_union",
    T.with_roles("county_visits", "state_visits", "census") + _RATES_SQL + rounded_sql("SELECT fips, year, rate AS heat_ed_rate_per_100k FROM merged", "heat_ed_rate_per_100k"),
)
def precedence_union(spark, d):
    people = clean.prepare_population(T.census(spark, d))
    county, state = clean.split_by_resolution(clean.clean_ed_visits(T.visits(spark, d)))
    merged = joins.precedence_union(K.county_rates(county, people), K.state_rates(state, people), ["fips", "year"])
    return rounded(merged, "heat_ed_rate_per_100k")


@query(
    "hierarchy_disaggregation",
    T.with_roles("county_visits", "state_visits", "census") + _RATES_SQL + rounded_sql("SELECT fips, year, rate AS heat_ed_rate_per_100k FROM spread", "heat_ed_rate_per_100k"),
)
def hierarchy_disaggregation(spark, d):
    people = clean.prepare_population(T.census(spark, d))
    _, state = clean.split_by_resolution(clean.clean_ed_visits(T.visits(spark, d)))
    return rounded(K.state_rates(state, people), "heat_ed_rate_per_100k")


@query(
    "rate_per_100k",
    T.with_roles("county_visits", "state_visits", "census") + _RATES_SQL + rounded_sql("SELECT fips, year, rate AS heat_ed_rate_per_100k FROM rates WHERE rate IS NOT NULL", "heat_ed_rate_per_100k"),
)
def rate_per_100k(spark, d):
    people = clean.prepare_population(T.census(spark, d))
    county, _ = clean.split_by_resolution(clean.clean_ed_visits(T.visits(spark, d)))
    return rounded(K.county_rates(county, people), "heat_ed_rate_per_100k")


@query(
    "semi_join_pairs",
    T.with_roles("housing", "panel") + "\nSELECT fips, year, EXISTS (SELECT 1 FROM housing h WHERE h.fips = p.fips AND h.year = p.year) AS listed FROM panel p",
)
def semi_join_pairs(spark, d):
    return joins.flag_members(T.panel(spark, d).select("fips", "year"), T.housing(spark, d), ["fips", "year"], "listed")


@query(
    "nearest_year_asof_join",
    T.with_roles("housing", "panel") + """
    SELECT fips, year, (SELECT arg_min(h.total_housing_units, abs(h.year - p.year) * 10000 + h.year) FROM housing h WHERE h.fips = p.fips) AS total_housing_units,
    (SELECT arg_min(h.year, abs(h.year - p.year) * 10000 + h.year) FROM housing h WHERE h.fips = p.fips) AS total_housing_units_year FROM panel p""",
)
def nearest_year(spark, d):
    return joins.nearest_year(T.panel(spark, d).select("fips", "year"), T.housing(spark, d), "total_housing_units")


_NAMES = """names AS (SELECT printf('%02d', s_nationkey + 1) AS st, concat('saint ', s_suppkey % 50) AS nm, min(printf('%02d%03d', s_nationkey + 1, s_suppkey)) AS fips
    FROM supplier WHERE printf('%02d', s_nationkey + 1) NOT IN ('03', '07', '14') GROUP BY ALL)"""


@query(
    "name_crosswalk",
    "WITH " + _NAMES + "\nSELECT fips, nm AS county_norm FROM names",
)
def name_crosswalk(spark, d):
    return joins.name_crosswalk(_attributes(spark, d)).select("fips", "county_norm")


def _attributes(spark, d):
    """County names that repeat within a state."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    return T.table(spark, d, "supplier").select(
        F.format_string("%02d", n + 1).alias("state_fips"), T.county(n, k).alias("county_fips"),
        F.concat(F.lit("St. "), (k % 50).cast("string")).alias("county_name"),
    )


@query(
    "name_crosswalk_join",
    T.with_roles("decl") + ", " + _NAMES + """,
    paid AS (SELECT l_orderkey AS dn, printf('%02d', s_nationkey + 1) AS st, concat('saint ', s_suppkey % 50) AS nm, sum(l_quantity) AS amount, count(*) AS regs FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    years AS (SELECT disaster_number, min(year) AS year FROM decl GROUP BY ALL),
    sums AS (SELECT fips, year, sum(amount) AS amount, CAST(sum(regs) AS DOUBLE) AS regs FROM paid JOIN names USING (st, nm) JOIN years ON disaster_number = CAST(dn AS VARCHAR) GROUP BY ALL)
    SELECT disaster_number, decl.fips, decl.year, coalesce(amount, ia_amount) AS ia_amount, coalesce(regs, registrant_count) AS registrant_count FROM decl LEFT JOIN sums ON sums.fips = decl.fips AND sums.year = decl.year""",
)
def name_crosswalk_join(spark, d):
    from hearthline import params as P

    li = T.table(spark, d, "lineitem").join(T.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    abbr = P.lookup(P.STATE_ABBR, F.format_string("%02d", F.col("s_nationkey") + 1))
    payouts = li.groupBy(
        F.col("l_orderkey").cast("string").alias("disaster_number"), abbr.alias("state"),
        F.concat(F.lit("ST. "), (F.col("s_suppkey") % 50).cast("string"), F.lit(" (County)")).alias("county"),
    ).agg(F.sum("l_quantity").alias("ia_amount"), F.count(F.lit(1)).cast("double").alias("registrant_count"))
    return joins.enrich_declarations(T.declarations(spark, d), payouts, joins.name_crosswalk(_attributes(spark, d)))


@query(
    "zone_explode_join",
    """WITH cross_ AS (SELECT l_orderkey, printf('%02d%03d', s_nationkey + 1, s_suppkey) AS fips, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS f
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, s_nationkey, s_suppkey)"""
    + rounded_sql(
        """SELECT CASE WHEN count(*) OVER w > 1 THEN concat('E', o_orderkey, '_z', row_number() OVER (PARTITION BY o_orderkey ORDER BY fips) - 1) ELSE concat('E', o_orderkey) END AS event_id,
        fips, CAST(o_orderdate AS DATE) AS date, o_totalprice * f AS property_damage, 10 * f AS crop_damage, 2 * f AS injuries_direct, f AS deaths_direct
        FROM orders JOIN cross_ ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_orderkey)""",
        "property_damage crop_damage injuries_direct deaths_direct",
    ),
)
def zone_explode_join(spark, d):
    shares = ["property_damage", "crop_damage", "injuries_direct", "deaths_direct"]
    result = joins.explode_zones(T.zone_events(spark, d), T.zone_crosswalk(spark, d), shares)
    return rounded(result, " ".join(shares))


@query(
    "add_zero_members",
    "SELECT CAST(s_suppkey AS VARCHAR) AS station_id, printf('%02d', s_nationkey + 1) AS fips, count(*) OVER (PARTITION BY s_nationkey) AS station_count FROM supplier WHERE s_acctbal > 3000 "
    "UNION ALL SELECT NULL, printf('%02d', n_nationkey + 1), 0 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)",
)
def add_zero_members(spark, d):
    from hearthline.operators.rollups import points_per_county

    stations = T.table(spark, d, "supplier").where("s_acctbal > 3000").select(
        F.col("s_suppkey").cast("string").alias("station_id"), T.state(F.col("s_nationkey")).alias("fips")
    )
    counties = T.table(spark, d, "nation").select(T.state(F.col("n_nationkey")).alias("fips"))
    counted = points_per_county(stations, "station_count").select("station_id", "fips", "station_count")
    return joins.add_zero_members(counted, counties, "fips", "station_count")


@query(
    "points_per_county",
    "SELECT CAST(c_custkey AS VARCHAR) AS station_id, printf('%02d', c_nationkey + 1) AS fips, count(*) OVER (PARTITION BY c_nationkey) AS station_count FROM customer",
)
def points_per_county(spark, d):
    from hearthline.operators.rollups import points_per_county as count

    rows = T.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("station_id"), T.state(F.col("c_nationkey")).alias("fips")
    )
    return count(rows, "station_count").select("station_id", "fips", "station_count")
