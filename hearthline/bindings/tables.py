"""The method's input roles, read from the driver's tables.

Each role exists twice: as a Spark DataFrame and as a SQL common table
expression of the same rows.  Values that later decide ranks are rounded on
both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import geometry as G

SCORING_YEAR = 2000
FIRST_YEAR = 1995
SETTINGS = P.Settings(scoring_year=SCORING_YEAR)
COMPONENTS = list(P.COMPONENT_IDS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def county(nation: Column, number: Column) -> Column:
    """County-like key: two-digit state (nation plus one) and a number."""
    return F.format_string("%02d%03d", (nation + 1).cast("long"), number.cast("long"))


def state(nation: Column) -> Column:
    return F.format_string("%02d", (nation + 1).cast("long"))


def fixed(value: Column, digits: int = 10) -> Column:
    """Rounded beyond any exact tie of the inputs, yet above the noise of sums."""
    return F.round(value, digits)


def suppliers(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), county(F.col("s_nationkey"), F.col("s_suppkey")).alias("fips")
    )


def lines(spark, d) -> DataFrame:
    """Line items with year and short names."""
    return table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber",
        F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"),
        F.col("l_tax").alias("t"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
    )


def by_county_year(spark, d, rows: DataFrame, **aggregates: Column) -> DataFrame:
    """Aggregates per supplier and year, keyed as counties.  Grouping comes before the join."""
    grouped = rows.groupBy("l_suppkey", "year").agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.join(suppliers(spark, d), "l_suppkey").select("fips", "year", *aggregates)


def panel(spark, d) -> DataFrame:
    """County-year panel with the twelve components."""
    q, p, dsc, t = F.col("q"), F.col("p"), F.col("d"), F.col("t")
    when = lambda cond, value: F.when(cond, value)
    return by_county_year(
        spark, d, lines(spark, d),
        hdd_anomaly=fixed(F.avg(q) - 25.5),
        cdd_anomaly=fixed(F.avg(when(F.col("rf") == "R", q)) - F.avg(q)),
        extreme_heat_days=F.count_if(q > 45).cast("double"),
        storm_severity=fixed(F.sum(when(dsc >= 0.085, p)) / 10000.0),
        pm25_annual=fixed(F.avg(t) * 100.0),
        aqi_unhealthy_days=F.count_if(dsc >= 0.095).cast("double"),
        flood_exposure=fixed(F.sum(p * dsc) / 1000.0, 8),
        wildfire_score=fixed(F.avg(when(q >= 50, p)) / 1000.0),
        drought_score=fixed(F.avg(when(F.col("ls") == "F", dsc)) * 100.0),
        energy_cost_attributed=fixed(F.sum(p * (1.0 - dsc)) / 1000.0, 8),
        health_burden=fixed(F.max(when(q <= 1, p)) / 1000.0),
        fema_ia_burden=fixed(F.sum(when((F.col("rf") == "R") & (dsc < 0.005), p * t)) / 100.0),
    )


def housing(spark, d) -> DataFrame:
    """Housing units in some years of each county only."""
    some = lines(spark, d).where((F.col("q") >= 50) & (F.col("rf") == "R"))
    return by_county_year(spark, d, some, total_housing_units=(F.sum("l_linenumber") * 1000).cast("double"))


def census(spark, d) -> DataFrame:
    """Housing, population and income of every county-year."""
    return by_county_year(
        spark, d, lines(spark, d),
        total_housing_units=F.sum("q"),
        population=F.sum("l_partkey").cast("double"),
        median_household_income=fixed(F.avg("p"), 8),
    )


def storm_events(spark, d) -> DataFrame:
    """One event per line item, with missing, zero and negative damages."""
    dsc, t, p = F.col("d"), F.col("t"), F.col("p")
    prop = (
        F.when(dsc >= 0.025, p * F.col("q")).when(dsc >= 0.015, -p).when(dsc >= 0.005, F.lit(0.0))
    )
    crop = F.when(t >= 0.015, p * t).when(t >= 0.005, F.lit(0.0))
    return lines(spark, d).join(suppliers(spark, d), "l_suppkey").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("event_id"),
        "fips", "date", F.col("rf").alias("event_type"),
        prop.alias("property_damage"), crop.alias("crop_damage"),
    )


def declarations(spark, d) -> DataFrame:
    """Assistance declarations with missing and negative amounts."""
    t, dsc, p = F.col("t"), F.col("d"), F.col("p")
    amount = F.when(t >= 0.015, p * 100.0).when(t >= 0.005, -p)
    return lines(spark, d).join(suppliers(spark, d), "l_suppkey").select(
        F.col("l_orderkey").cast("string").alias("disaster_number"), "fips", "year",
        amount.alias("ia_amount"), F.when(dsc >= 0.005, F.col("l_linenumber").cast("double")).alias("registrant_count"),
    )


def visits(spark, d) -> DataFrame:
    """Visit counts of all lines by state, and of the lines that are visits of a county where it has any."""
    li = lines(spark, d)
    missing = F.lit(None).cast("double")
    of_county = F.count_if((F.col("q") >= 50) & (F.col("rf") == "A")).cast("double")
    some = by_county_year(spark, d, li, heat_ed_visits=of_county).where("heat_ed_visits > 0")
    of_state = (
        li.groupBy("l_suppkey", "year").agg(F.count(F.lit(1)).alias("n"))
        .join(suppliers(spark, d), "l_suppkey")
        .groupBy(F.substring("fips", 1, 2).alias("state_fips"), "year").agg(F.sum("n").cast("double").alias("heat_ed_visits"))
    )
    return some.select(
        "fips", F.substring("fips", 1, 2).alias("state_fips"), "year", "heat_ed_visits",
        missing.alias("population"), F.lit("county").alias("geo_resolution"),
    ).unionByName(
        of_state.select(
            F.col("state_fips").alias("fips"), "state_fips", "year", "heat_ed_visits",
            missing.alias("population"), F.lit("state").alias("geo_resolution"),
        )
    )


def station_map(spark, d) -> DataFrame:
    """Station (customer number) to county (its nation), plus counties without stations."""
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("station_id"), county(F.col("c_nationkey"), F.lit(1)).alias("fips")
    )
    empty = table(spark, d, "nation").select(
        F.lit(None).cast("string").alias("station_id"), county(F.col("n_nationkey"), F.lit(2)).alias("fips")
    )
    return customers.unionByName(empty)


def daily_obs(spark, d) -> DataFrame:
    """Station observations from the event stream; error events carry a quality flag."""
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("station_id"), F.to_date("ts").alias("date"),
        F.when(F.col("value") >= 1, F.col("value")).alias("tmax"), (F.col("value") - 10.0).alias("tmin"),
        F.when(bad, F.lit("X")).alias("q_flag_tmax"), F.lit("").alias("q_flag_tmin"),
    )


MIN_OBS = 20


def normals(spark, d) -> DataFrame:
    """Monthly normals of stations that are also supplier numbers."""
    return table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("station_id"), F.month("l_shipdate").alias("month")
    ).agg(fixed(F.avg("l_quantity") - 5.0).alias("normal_tmax"), fixed(F.avg("l_quantity") - 15.0).alias("normal_tmin"))


def weekly_drought(spark, d) -> DataFrame:
    """Category shares from order totals, some negative and some adding up badly."""
    u = F.col("o_totalprice") / 500000.0
    return table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        county(F.col("c_nationkey"), F.lit(1)).alias("fips"), F.to_date("o_orderdate").alias("date"),
        (20.0 * u).alias("d0_pct"), (15.0 * u).alias("d1_pct"), (10.0 * u).alias("d2_pct"),
        (5.0 * (u - 0.2)).alias("d3_pct"), F.when(u > 0.9, F.lit(30.0)).otherwise(0.0).alias("d4_pct"),
        (100.0 - 50.0 * u).alias("none_pct"),
    )


def readings(spark, d) -> DataFrame:
    """Air readings with negative, missing and impossible values."""
    kind, v = F.col("event_type"), F.col("value")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("monitor_id"), F.to_date("ts").alias("date"),
        F.when(kind == "error", -v).when(kind != "signup", v).alias("pm25_value"),
        F.when(kind == "view", v * 4.0).when(kind == "signup", v).when(kind == "error", F.lit(-1.0)).alias("aqi_value"),
    )


def monitor_map(spark, d) -> DataFrame:
    return station_map(spark, d).withColumnRenamed("station_id", "monitor_id")


def energy(spark, d) -> DataFrame:
    """State-year price and consumption from orders by nation."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(
        fixed(F.avg("o_totalprice") / 10000.0).alias("electricity_price_cents_kwh"),
        fixed(F.sum("o_totalprice") / 1000000.0).alias("electricity_consumption_mwh"),
    ).select(state(F.col("c_nationkey")).alias("state_fips"), "year", "electricity_price_cents_kwh", "electricity_consumption_mwh")


def households(spark, d) -> DataFrame:
    """Survey households from customers."""
    home = F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD", "MACHINERY")
    return table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey").cast("string").alias("household_id"), (F.col("n_regionkey") + 1).cast("int").alias("census_division"),
        F.when(home, F.lit("Single-family detached")).otherwise(F.lit("Mobile home")).alias("dwelling_type"),
        (F.col("c_acctbal") / 10.0 + 1000.0).alias("square_footage"),
        F.when(F.col("c_acctbal") < 7000, 3).otherwise(2).alias("num_occupants"),
        (F.col("c_acctbal") + 10000.0).alias("annual_electricity_kwh"),
    )


def zone_events(spark, d) -> DataFrame:
    """One zone event per order."""
    return table(spark, d, "orders").select(
        F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.col("o_orderkey").cast("string").alias("zone_id"), F.lit(None).cast("string").alias("fips"),
        F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("property_damage"),
        F.lit(10.0).alias("crop_damage"), F.lit(2.0).alias("injuries_direct"), F.lit(1.0).alias("deaths_direct"),
    )


def zone_crosswalk(spark, d) -> DataFrame:
    """Counties of a zone: suppliers of the order, by their share of lines."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("l_orderkey").agg(F.sum("n").alias("total"))
    return per.join(whole, "l_orderkey").join(suppliers(spark, d), "l_suppkey").select(
        F.col("l_orderkey").cast("string").alias("zone_id"), "fips", (F.col("n") / F.col("total")).alias("area_fraction")
    )


def points(spark, d) -> DataFrame:
    """Places from the first two embedding coordinates."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select(
        F.format_string("%05d", F.col("vec_id")).alias("fips"), fixed(38.0 + 20.0 * e(0)).alias("lat"),
        fixed(-96.0 + 50.0 * e(1)).alias("lon"), fixed(e(2) * 100.0).alias("value"), "label",
    )


def box_of_nation(width: float = 5.76, height: float = 2.24) -> tuple[Column, Column, Column, Column]:
    """Box of a nation on a five-by-five grid with gaps between the boxes."""
    n = F.col("n_nationkey")
    west = F.lit(-114.0) + 7.2 * (n % 5)
    south = F.lit(31.0) + 2.8 * F.floor(n / 5)
    return west, south, west + width, south + height


def boxes(spark, d) -> DataFrame:
    """County polygons: one box per nation."""
    return table(spark, d, "nation").select(
        county(F.col("n_nationkey"), F.lit(1)).alias("fips"), G.box_rings(*box_of_nation()).alias("rings")
    )


# --- the same roles in SQL ----------------------------------------------------------

_SUPPLIERS = "sup AS (SELECT s_suppkey AS l_suppkey, printf('%02d%03d', s_nationkey + 1, s_suppkey) AS fips FROM supplier)"
_LINES = """li AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year,
    CAST(l_shipdate AS DATE) AS date, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t,
    l_returnflag AS rf, l_linestatus AS ls FROM lineitem)"""

ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "sup": ((), _SUPPLIERS),
    "li": ((), _LINES),
    "panel": (("sup", "li"), """panel AS (SELECT fips, year,
    round(avg(q) - 25.5, 10) AS hdd_anomaly,
    round(avg(CASE WHEN rf = 'R' THEN q END) - avg(q), 10) AS cdd_anomaly,
    CAST(count(*) FILTER (WHERE q > 45) AS DOUBLE) AS extreme_heat_days,
    round(sum(CASE WHEN d >= 0.085 THEN p END) / 10000.0, 10) AS storm_severity,
    round(avg(t) * 100.0, 10) AS pm25_annual,
    CAST(count(*) FILTER (WHERE d >= 0.095) AS DOUBLE) AS aqi_unhealthy_days,
    round(sum(p * d) / 1000.0, 8) AS flood_exposure,
    round(avg(CASE WHEN q >= 50 THEN p END) / 1000.0, 10) AS wildfire_score,
    round(avg(CASE WHEN ls = 'F' THEN d END) * 100.0, 10) AS drought_score,
    round(sum(p * (1.0 - d)) / 1000.0, 8) AS energy_cost_attributed,
    round(max(CASE WHEN q <= 1 THEN p END) / 1000.0, 10) AS health_burden,
    round(sum(CASE WHEN rf = 'R' AND d < 0.005 THEN p * t END) / 100.0, 10) AS fema_ia_burden
    FROM li JOIN sup USING (l_suppkey) GROUP BY fips, year)"""),
    "panel_long": (("panel",), """panel_long AS (UNPIVOT panel ON """ + ", ".join(P.COMPONENT_IDS)
                   + " INTO NAME component VALUE value)"),
    "housing": (("sup", "li"), """housing AS (SELECT fips, year, CAST(sum(l_linenumber) * 1000 AS DOUBLE) AS total_housing_units
    FROM li JOIN sup USING (l_suppkey) WHERE q >= 50 AND rf = 'R' GROUP BY fips, year)"""),
    "census": (("sup", "li"), """census AS (SELECT fips, year, sum(q) AS total_housing_units,
    CAST(sum(l_partkey) AS DOUBLE) AS population, round(avg(p), 8) AS median_household_income
    FROM li JOIN sup USING (l_suppkey) GROUP BY fips, year)"""),
    "storms": (("sup", "li"), """storms AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id, fips, date, rf AS event_type,
    CASE WHEN d >= 0.025 THEN p * q WHEN d >= 0.015 THEN -p WHEN d >= 0.005 THEN 0.0 END AS property_damage,
    CASE WHEN t >= 0.015 THEN p * t WHEN t >= 0.005 THEN 0.0 END AS crop_damage
    FROM li JOIN sup USING (l_suppkey))"""),
    "damages": (("storms",), """damages AS (SELECT event_id, fips, date, event_type,
    CASE WHEN property_damage IS NULL AND crop_damage IS NULL THEN NULL
         ELSE coalesce(greatest(property_damage, 0), 0) + coalesce(greatest(crop_damage, 0), 0) END AS total_damage
    FROM storms)"""),
    "tiers": (("damages",), """tiers AS (SELECT *,
    CASE WHEN NOT total_damage > 0 THEN NULL WHEN total_damage < 50000 THEN 1.0 WHEN total_damage < 500000 THEN 2.0
         WHEN total_damage < 5000000 THEN 3.0 WHEN total_damage IS NOT NULL THEN 4.0 END::DOUBLE AS severity_tier,
    CASE WHEN NOT total_damage > 0 THEN NULL WHEN total_damage < 50000 THEN 1.0 WHEN total_damage < 500000 THEN 3.0
         WHEN total_damage < 5000000 THEN 7.0 WHEN total_damage IS NOT NULL THEN 15.0 END::DOUBLE AS tier_weight
    FROM damages)"""),
    "storm_years": (("tiers",), """storm_years AS (SELECT fips, CAST(year(date) AS INTEGER) AS year,
    coalesce(sum(tier_weight), 0) AS county_severity_raw, count(event_id) AS event_count, sum(total_damage) AS total_damage,
    count(severity_tier) AS tiered_event_count, count(*) FILTER (WHERE severity_tier IS NULL) AS unreported_event_count,
    count(*) FILTER (WHERE severity_tier IS NULL) * 100.0 / count(event_id) AS pct_missing_damage
    FROM tiers GROUP BY ALL)"""),
    "decl": (("sup", "li"), """decl AS (SELECT CAST(l_orderkey AS VARCHAR) AS disaster_number, fips, year,
    CASE WHEN t >= 0.015 THEN p * 100.0 WHEN t >= 0.005 THEN -p END AS ia_amount,
    CASE WHEN d >= 0.005 THEN CAST(l_linenumber AS DOUBLE) END AS registrant_count
    FROM li JOIN sup USING (l_suppkey))"""),
    "county_visits": (("sup", "li"), """county_visits AS (SELECT fips, year, CAST(count(*) FILTER (WHERE q >= 50 AND rf = 'A') AS DOUBLE) AS heat_ed_visits
    FROM li JOIN sup USING (l_suppkey) GROUP BY fips, year HAVING heat_ed_visits > 0)"""),
    "state_visits": (("sup", "li"), """state_visits AS (SELECT substr(fips, 1, 2) AS state_fips, year, CAST(count(*) AS DOUBLE) AS heat_ed_visits
    FROM li JOIN sup USING (l_suppkey) GROUP BY ALL)"""),
    "stations": ((), """stations AS (SELECT CAST(c_custkey AS VARCHAR) AS station_id, printf('%02d001', c_nationkey + 1) AS fips FROM customer
    UNION ALL SELECT NULL, printf('%02d002', n_nationkey + 1) FROM nation)"""),
    "obs": ((), """obs AS (SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date,
    CASE WHEN value >= 1 THEN value END AS tmax, value - 10.0 AS tmin,
    CASE WHEN event_type = 'error' THEN 'X' END AS q_flag_tmax, '' AS q_flag_tmin FROM events)"""),
    "good_obs": (("obs",), """good_obs AS (SELECT *, CAST(year(date) AS INTEGER) AS year,
    greatest(0.0, CAST(33 AS DOUBLE) * 5 / 9 - (tmax + tmin) / 2) AS hdd, greatest(0.0, (tmax + tmin) / 2 - CAST(33 AS DOUBLE) * 5 / 9) AS cdd
    FROM obs WHERE tmax IS NOT NULL AND tmin IS NOT NULL AND coalesce(q_flag_tmax, '') = '' AND coalesce(q_flag_tmin, '') = '')"""),
    "normals": ((), """normals AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, CAST(month(l_shipdate) AS INTEGER) AS month,
    round(avg(l_quantity) - 5.0, 10) AS normal_tmax, round(avg(l_quantity) - 15.0, 10) AS normal_tmin FROM lineitem GROUP BY ALL)"""),
    "normal_year": (("normals",), """normal_year AS (SELECT station_id,
    sum(greatest(0.0, CAST(33 AS DOUBLE) * 5 / 9 - (normal_tmax + normal_tmin) / 2) * [31,28,31,30,31,30,31,31,30,31,30,31][month]) AS normal_hdd_annual,
    sum(greatest(0.0, (normal_tmax + normal_tmin) / 2 - CAST(33 AS DOUBLE) * 5 / 9) * [31,28,31,30,31,30,31,31,30,31,30,31][month]) AS normal_cdd_annual
    FROM normals GROUP BY station_id HAVING count(DISTINCT month) = 12)"""),
    "station_year": (("good_obs",), f"""station_year AS (SELECT station_id, year, sum(hdd) AS hdd_annual, sum(cdd) AS cdd_annual
    FROM good_obs GROUP BY ALL HAVING count(*) >= {MIN_OBS})"""),
    "drought": ((), """drought AS (SELECT printf('%02d001', c_nationkey + 1) AS fips, CAST(o_orderdate AS DATE) AS date,
    20.0 * (o_totalprice / 500000.0) AS d0_pct, 15.0 * (o_totalprice / 500000.0) AS d1_pct, 10.0 * (o_totalprice / 500000.0) AS d2_pct,
    5.0 * (o_totalprice / 500000.0 - 0.2) AS d3_pct, CASE WHEN o_totalprice / 500000.0 > 0.9 THEN 30.0 ELSE 0.0 END::DOUBLE AS d4_pct,
    100.0 - 50.0 * (o_totalprice / 500000.0) AS none_pct FROM orders JOIN customer ON o_custkey = c_custkey)"""),
    "drought_ok": (("drought",), """drought_ok AS (SELECT fips, date, CAST(year(date) AS INTEGER) AS year, d0_pct, d1_pct, d2_pct, greatest(d3_pct, 0.0) AS d3_pct, d4_pct, none_pct
    FROM drought WHERE NOT abs(d0_pct + d1_pct + d2_pct + greatest(d3_pct, 0.0) + d4_pct + none_pct - 100.0) > 20.0)"""),
    "air": ((), """air AS (SELECT CAST(user_id AS VARCHAR) AS monitor_id, CAST(ts AS DATE) AS date,
    CASE WHEN event_type = 'error' THEN -value WHEN event_type <> 'signup' THEN value END AS pm25_raw,
    CASE WHEN event_type = 'view' THEN value * 4.0 WHEN event_type = 'signup' THEN value WHEN event_type = 'error' THEN -1.0 END AS aqi_raw
    FROM events)"""),
    "air_ok": (("air",), """air_ok AS (SELECT monitor_id, date, CAST(year(date) AS INTEGER) AS year, pm25_value, aqi_value FROM (SELECT *,
    CASE WHEN pm25_raw >= 0 THEN pm25_raw END AS pm25_value, CASE WHEN aqi_raw BETWEEN 0 AND 500 THEN aqi_raw END AS aqi_value FROM air)
    WHERE pm25_value IS NOT NULL OR aqi_value IS NOT NULL)"""),
    "air_daily": (("air_ok", "stations"), """air_daily AS (SELECT fips, date, year, daily_pm25, coalesce(daily_aqi,
    CASE WHEN daily_pm25 <= 12.0 THEN round_even((50.0 / 12.0) * daily_pm25, 0)
         WHEN daily_pm25 <= 35.4 THEN round_even((49.0 / (35.4::DOUBLE - 12.1::DOUBLE)) * (daily_pm25 - 12.1) + 51, 0)
         WHEN daily_pm25 <= 55.4 THEN round_even((49.0 / (55.4::DOUBLE - 35.5::DOUBLE)) * (daily_pm25 - 35.5) + 101, 0)
         WHEN daily_pm25 <= 150.4 THEN round_even((49.0 / (150.4::DOUBLE - 55.5::DOUBLE)) * (daily_pm25 - 55.5) + 151, 0)
         WHEN daily_pm25 <= 250.4 THEN round_even((99.0 / (250.4::DOUBLE - 150.5::DOUBLE)) * (daily_pm25 - 150.5) + 201, 0)
         WHEN daily_pm25 <= 350.4 THEN round_even((99.0 / (350.4::DOUBLE - 250.5::DOUBLE)) * (daily_pm25 - 250.5) + 301, 0)
         WHEN daily_pm25 <= 500.4 THEN round_even((99.0 / (500.4::DOUBLE - 350.5::DOUBLE)) * (daily_pm25 - 350.5) + 401, 0)
         WHEN daily_pm25 IS NOT NULL THEN 500.0 END) AS daily_aqi
    FROM (SELECT fips, date, year, avg(pm25_value) AS daily_pm25, max(aqi_value) AS daily_aqi
          FROM air_ok JOIN stations ON monitor_id = station_id GROUP BY ALL))"""),
    "air_spikes": (("air_daily",), """air_spikes AS (SELECT *, quantile_cont(daily_pm25, 0.5) OVER (PARTITION BY fips ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS pm25_baseline
    FROM air_daily)"""),
    "energy": ((), """energy AS (SELECT printf('%02d', c_nationkey + 1) AS state_fips, CAST(year(o_orderdate) AS INTEGER) AS year,
    round(avg(o_totalprice) / 10000.0, 10) AS electricity_price_cents_kwh, round(sum(o_totalprice) / 1000000.0, 10) AS electricity_consumption_mwh
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""),
    "homes": ((), """homes AS (SELECT CAST(c_custkey AS VARCHAR) AS household_id, n_regionkey + 1 AS census_division,
    CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 'Single-family detached' ELSE 'Mobile home' END AS dwelling_type,
    c_acctbal / 10.0 + 1000.0 AS square_footage, CASE WHEN c_acctbal < 7000 THEN 3 ELSE 2 END AS num_occupants,
    c_acctbal + 10000.0 AS annual_electricity_kwh FROM customer JOIN nation ON c_nationkey = n_nationkey)"""),
    "home_ratios": (("homes",), """home_ratios AS (SELECT census_division, n_match,
    CASE WHEN n_match >= 30 THEN matched / everyone ELSE (SELECT avg(annual_electricity_kwh) FILTER (WHERE dwelling_type LIKE 'Single-family%' AND square_footage BETWEEN 1500 AND 2100 AND num_occupants = 3) / avg(annual_electricity_kwh) FROM homes) END AS norm_factor
    FROM (SELECT census_division, count(*) FILTER (WHERE ok) AS n_match, avg(annual_electricity_kwh) FILTER (WHERE ok) AS matched, avg(annual_electricity_kwh) AS everyone
          FROM (SELECT *, dwelling_type LIKE 'Single-family%' AND square_footage BETWEEN 1500 AND 2100 AND num_occupants = 3 AS ok FROM homes) GROUP BY census_division))"""),
    "anomalies": (("panel",), """anomalies AS (SELECT substr(fips, 1, 2) AS state_fips, year, avg(hdd_anomaly) AS hdd_anomaly, avg(cdd_anomaly) AS cdd_anomaly
    FROM panel WHERE hdd_anomaly IS NOT NULL AND cdd_anomaly IS NOT NULL GROUP BY ALL)"""),
    "places": ((), """places AS (SELECT printf('%05d', vec_id) AS fips, round(38.0 + 20.0 * embedding[1]::DOUBLE, 10) AS lat,
    round(-96.0 + 50.0 * embedding[2]::DOUBLE, 10) AS lon, round(embedding[3]::DOUBLE * 100.0, 10) AS value, label FROM embeddings)"""),
    "boxes": ((), """boxes AS (SELECT printf('%02d001', n_nationkey + 1) AS fips, -114.0::DOUBLE + 7.2 * (n_nationkey % 5) AS west,
    31.0::DOUBLE + 2.8 * (n_nationkey // 5) AS south, -114.0::DOUBLE + 7.2 * (n_nationkey % 5) + 5.76 AS east,
    31.0::DOUBLE + 2.8 * (n_nationkey // 5) + 2.24 AS north FROM nation)"""),
}


def with_roles(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of the roles and everything they need, in order."""
    ordered: list[str] = []

    def add(name):
        for needed in ROLES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ROLES[n][1] for n in ordered)
