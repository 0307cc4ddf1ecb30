"""Aggregation, window and scalar-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.bindings import tables as T
from hearthline.bindings.flow import _DROUGHT, _DROUGHT_SQL, _PAID_SQL, STATE_PANEL_SQL, STATE_ROLES, state_panel
from hearthline.bindings.registry import query, rounded, rounded_sql
from hearthline.functions import columns as C
from hearthline.operators import clean, rollups, windows
from hearthline.plans import components as K


def good_obs(spark, d):
    return clean.filter_quality_flags(T.daily_obs(spark, d), ["tmax", "tmin"], ["q_flag_tmax", "q_flag_tmin"])


@query("annual_station_sums", T.with_roles("station_year") + rounded_sql("SELECT * FROM station_year", "hdd_annual cdd_annual"))
def annual_station_sums(spark, d):
    tmax, tmin = F.col("tmax"), F.col("tmin")
    sums = rollups.annual_station_sums(
        good_obs(spark, d), {"hdd_annual": C.heating_degrees(tmax, tmin), "cdd_annual": C.cooling_degrees(tmax, tmin)}, T.MIN_OBS
    )
    return rounded(sums, "hdd_annual cdd_annual")


@query("normal_annual", T.with_roles("normal_year") + rounded_sql("SELECT * FROM normal_year", "normal_hdd_annual normal_cdd_annual"))
def normal_annual(spark, d):
    return rounded(rollups.normal_annual(T.normals(spark, d)), "normal_hdd_annual normal_cdd_annual")


@query(
    "county_mean",
    T.with_roles("station_year", "stations") + rounded_sql("SELECT fips, year, avg(hdd_annual) AS hdd_annual FROM station_year JOIN stations USING (station_id) GROUP BY ALL", "hdd_annual"),
)
def county_mean(spark, d):
    sums = rollups.annual_station_sums(good_obs(spark, d), {"hdd_annual": C.heating_degrees(F.col("tmax"), F.col("tmin"))}, T.MIN_OBS)
    return rounded(rollups.county_mean(sums, T.station_map(spark, d), ["hdd_annual"]), "hdd_annual")


def air_daily(spark, d):
    return rollups.county_daily(clean.clean_readings(T.readings(spark, d)), T.monitor_map(spark, d))


@query("county_daily", T.with_roles("air_daily") + rounded_sql("SELECT * FROM air_daily", "daily_pm25:8 daily_aqi:8"))
def county_daily(spark, d):
    return rounded(air_daily(spark, d), "daily_pm25:8 daily_aqi:8")


@query(
    "annual_exceedance_counts",
    T.with_roles("air_daily") + rounded_sql(
        """SELECT fips, year, avg(daily_pm25) AS pm25_annual_avg, count(*) FILTER (WHERE daily_aqi > 100) AS aqi_unhealthy_days, count(*) FILTER (WHERE daily_aqi > 150) AS aqi_very_unhealthy_days FROM air_daily GROUP BY ALL""",
        "pm25_annual_avg",
    ),
)
def annual_exceedances(spark, d):
    return rounded(rollups.annual_exceedances(air_daily(spark, d)), "pm25_annual_avg")


@query("event_rollup", T.with_roles("storm_years") + rounded_sql("SELECT * FROM storm_years", "county_severity_raw total_damage:2 pct_missing_damage"))
def event_rollup(spark, d):
    return rounded(rollups.event_rollup(K.event_tiers(T.storm_events(spark, d))), "county_severity_raw total_damage:2 pct_missing_damage")


@query("payout_rollup", T.with_roles("decl") + rounded_sql(_PAID_SQL, "total_ia_amount:2"))
def payout_rollup(spark, d):
    return rounded(rollups.payout_rollup(T.declarations(spark, d)), "total_ia_amount:2")


@query("drought_rollup", T.with_roles("drought_ok") + rounded_sql(_DROUGHT_SQL, _DROUGHT))
def drought_rollup(spark, d):
    return rounded(rollups.drought_rollup(clean.clean_weekly(T.weekly_drought(spark, d))), _DROUGHT)


@query("low_coverage_keys", T.with_roles("drought_ok") + "\nSELECT fips, year, count(DISTINCT date) AS n_weeks FROM drought_ok GROUP BY ALL HAVING count(DISTINCT date) < 75")
def low_coverage_keys(spark, d):
    return rollups.low_coverage_keys(clean.clean_weekly(T.weekly_drought(spark, d)), 75)


@query(
    "map_currency",
    """SELECT printf('%02d001', c_nationkey + 1) AS fips, strftime(max(CASE WHEN o_orderstatus <> 'P' AND o_totalprice < 12000 THEN CAST(o_orderdate AS DATE) END), '%Y-%m-%d') AS nfhl_effective_date,
    CASE WHEN max(CASE WHEN o_orderstatus <> 'P' AND o_totalprice < 12000 THEN CAST(o_orderdate AS DATE) END) >= DATE '2000-01-01' THEN 0 ELSE 1 END::INTEGER AS map_currency_flag
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""",
)
def map_currency(spark, d):
    orders = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    dated = F.when(F.col("o_orderstatus") == "P", F.lit("9999-01-01").cast("date")).when(F.col("o_totalprice") < 12000, F.to_date("o_orderdate"))
    panels = orders.select(T.county(F.col("c_nationkey"), F.lit(1)).alias("county_fips"), dated.alias("effective_date"))
    return rollups.map_currency(panels, 2010)


_ZONE_SQL = """zone_area AS (SELECT printf('%02d001', s_nationkey + 1) AS fips, CASE WHEN l_returnflag = 'R' THEN 'high' WHEN l_returnflag = 'A' THEN 'moderate' ELSE 'minimal' END AS risk, l_quantity AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    whole AS (SELECT printf('%02d001', n_nationkey + 1) AS fips, n_nationkey * 2000.0 AS area FROM nation)"""


@query(
    "area_pivot",
    "WITH " + _ZONE_SQL + rounded_sql(
        """SELECT fips, hi AS pct_area_high_risk, mo AS pct_area_moderate_risk, 3 * hi + mo AS flood_exposure FROM (SELECT fips, least(100, coalesce(sum(a) FILTER (WHERE risk = 'high'), 0) / area * 100) AS hi,
        least(100, coalesce(sum(a) FILTER (WHERE risk = 'moderate'), 0) / area * 100) AS mo FROM zone_area JOIN whole USING (fips) WHERE area > 0 GROUP BY fips, area)""",
        "pct_area_high_risk pct_area_moderate_risk flood_exposure",
    ),
)
def area_pivot(spark, d):
    flag = F.col("l_returnflag")
    zones = T.table(spark, d, "lineitem").join(T.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        T.county(F.col("s_nationkey"), F.lit(1)).alias("county_fips"), F.col("l_quantity").alias("area_m2"),
        F.when(flag == "R", "high").when(flag == "A", "moderate").otherwise("minimal").alias("risk_class"),
    )
    areas = T.table(spark, d, "nation").select(T.county(F.col("n_nationkey"), F.lit(1)).alias("fips"), (F.col("n_nationkey") * 2000.0).alias("county_area_m2"))
    return rounded(rollups.area_pivot(zones, areas), "pct_area_high_risk pct_area_moderate_risk flood_exposure")


@query(
    "housing_share",
    "SELECT printf('%02d', c_nationkey + 1) AS fips, round(coalesce(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey ELSE 0 END) * 100.0 / nullif(sum(c_custkey), 0), 0), 6) AS pct_hu_high_risk FROM customer GROUP BY c_nationkey",
)
def housing_share(spark, d):
    points = T.table(spark, d, "customer").select(
        T.state(F.col("c_nationkey")).alias("county_fips"), F.col("c_custkey").cast("double").alias("housing_units"),
        (F.col("c_mktsegment") == "BUILDING").alias("inside"),
    )
    return rounded(rollups.housing_share(points, "inside"), "pct_hu_high_risk")


@query(
    "zonal_class_stats",
    """WITH px AS (SELECT printf('%02d', s_nationkey + 1) AS fips, l_linenumber AS class FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber BETWEEN 1 AND 5)"""
    + rounded_sql(
        """SELECT printf('%02d', n_nationkey + 1) AS fips, avg(class) AS whp_mean, CAST(max(class) AS DOUBLE) AS whp_max, coalesce(count(*) FILTER (WHERE class >= 4) * 100.0 / nullif(count(class), 0), 0) AS pct_high_hazard
        FROM nation LEFT JOIN px ON px.fips = printf('%02d', n_nationkey + 1) GROUP BY n_nationkey""",
        "whp_mean pct_high_hazard",
    ),
)
def zonal_class_stats(spark, d):
    pixels = T.table(spark, d, "lineitem").join(T.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        T.state(F.col("s_nationkey")).alias("fips"), F.col("l_linenumber").alias("class")
    )
    counties = T.table(spark, d, "nation").select(T.state(F.col("n_nationkey")).alias("fips"))
    return rounded(rollups.zonal_class_stats(pixels, counties), "whp_mean pct_high_hazard")


FIRE_SQL = """fire AS (SELECT fips, count(*) AS fire_event_count, sum(coalesce(property_damage, 0) + coalesce(crop_damage, 0)) AS fire_damage FROM storms WHERE event_type = 'R' AND year(date) BETWEEN 1996 AND 2000 GROUP BY fips),
    activity AS (SELECT *, least(5.0, ln(1 + fire_damage) / ln(1 + (SELECT CASE WHEN quantile_cont(fire_damage, 0.95) > 0 THEN quantile_cont(fire_damage, 0.95) ELSE 1 END FROM fire)) * 5) AS wildfire_activity_score FROM fire)"""


@query("trailing_event_activity", T.with_roles("storms") + ", " + FIRE_SQL + rounded_sql("SELECT * FROM activity", "fire_damage:2 wildfire_activity_score"))
def trailing_activity(spark, d):
    return rounded(rollups.trailing_activity(T.storm_events(spark, d), 2000, "R"), "fire_damage:2 wildfire_activity_score")


@query(
    "state_means",
    T.with_roles("panel", "census") + rounded_sql(
        "SELECT substr(fips, 1, 2) AS state_fips, year, sum(population) AS population, avg(hdd_anomaly) AS hdd_anomaly FROM panel JOIN census USING (fips, year) GROUP BY ALL", "population:2 hdd_anomaly:9"
    ),
)
def state_means(spark, d):
    rows = T.panel(spark, d).join(T.census(spark, d), ["fips", "year"])
    return rounded(rollups.state_rollup(rows, {"population": "population"}, {"hdd_anomaly": "hdd_anomaly"}), "population:2 hdd_anomaly:9")


@query("conditional_ratio_by_group", T.with_roles("home_ratios") + "\nSELECT CAST(census_division AS INTEGER) AS census_division, n_match, round(norm_factor, 8) AS norm_factor FROM home_ratios")
def baseline_ratios(spark, d):
    return rounded(rollups.baseline_ratios(T.households(spark, d)), "norm_factor:8")


@query(
    "method_majority",
    """SELECT CAST(user_id AS VARCHAR) AS fips, CAST(year(ts) AS INTEGER) AS year, count(*) AS smoke_days,
    CASE WHEN count(*) FILTER (WHERE event_type = 'view') > count(*) FILTER (WHERE event_type <> 'view') THEN 'hms' WHEN count(*) FILTER (WHERE event_type = 'view') < count(*) FILTER (WHERE event_type <> 'view') THEN 'spike_detection' ELSE 'mixed' END AS smoke_day_method
    FROM events GROUP BY ALL""",
)
def method_majority(spark, d):
    smoke = T.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("fips"), F.year("ts").alias("year"),
        F.when(F.col("event_type") == "view", "hms").otherwise("spike_detection").alias("method"),
    )
    return rollups.method_majority(smoke)


@query(
    "annual_index",
    """SELECT CAST(l_suppkey AS VARCHAR) AS area_code, CAST(year(l_shipdate) AS INTEGER) AS year,
    round(CASE WHEN count(*) FILTER (WHERE l_quantity >= 50) > 0 THEN max(l_extendedprice) FILTER (WHERE l_quantity >= 50) ELSE avg(l_extendedprice) END, 6) AS food_cpi_index,
    CASE WHEN count(*) FILTER (WHERE l_quantity >= 50) > 0 THEN 'M13' ELSE 'computed' END AS period_type FROM lineitem GROUP BY ALL""",
)
def annual_index(spark, d):
    period = F.when(F.col("l_quantity") >= 50, "M13").otherwise(F.concat(F.lit("M"), F.lpad(F.month("l_shipdate").cast("string"), 2, "0")))
    monthly = T.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("area_code"), F.year("l_shipdate").alias("year"), period.alias("period"), F.col("l_extendedprice").alias("value")
    )
    return rounded(rollups.annual_index(monthly), "food_cpi_index")


@query(
    "wide_pivot",
    """SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date, min(value) FILTER (WHERE event_type = 'view') AS tmax, min(value) FILTER (WHERE event_type = 'click') AS tmin,
    '' AS q_flag_tmax, CASE WHEN count(*) FILTER (WHERE event_type = 'click') > 0 THEN 'B' ELSE '' END AS q_flag_tmin FROM events GROUP BY ALL""",
)
def wide_pivot(spark, d):
    long = T.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("station_id"), F.to_date("ts").alias("date"), F.upper("event_type").alias("element"), "value",
        F.when(F.col("event_type") == "click", "B").otherwise("").alias("q_flag"),
    )
    return rollups.wide_pivot(long, {"VIEW": "tmax", "CLICK": "tmin"})


@query(
    "pct_of_total",
    """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category, sum(o_totalprice) AS annual_expenditure FROM orders GROUP BY ALL)"""
    + rounded_sql("SELECT category, y.year, annual_expenditure, annual_expenditure / t * 100 AS pct_of_total FROM y JOIN (SELECT year, annual_expenditure AS t FROM y WHERE category = '1-URGENT') USING (year)", "annual_expenditure:2 pct_of_total"),
)
def pct_of_total(spark, d):
    yearly = T.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("category")).agg(
        F.sum("o_totalprice").alias("annual_expenditure")
    )
    return rounded(rollups.pct_of_total(yearly, F.col("category") == "1-URGENT"), "annual_expenditure:2 pct_of_total")


# --- windows ----------------------------------------------------------------------------


@query("rolling_median_baseline", T.with_roles("air_spikes") + rounded_sql("SELECT fips, date, daily_pm25, pm25_baseline FROM air_spikes", "daily_pm25:8 pm25_baseline:8"))
def rolling_median(spark, d):
    result = windows.rolling_median_baseline(air_daily(spark, d)).select("fips", "date", "daily_pm25", "pm25_baseline")
    return rounded(result, "daily_pm25:8 pm25_baseline:8")


@query("spike_detection", T.with_roles("air_spikes") + "\nSELECT fips, date, year, 'spike_detection' AS method FROM air_spikes WHERE daily_pm25 > 1.5 * pm25_baseline")
def spike_detection(spark, d):
    return windows.spike_days(air_daily(spark, d))


@query(
    "covered_smoke_days",
    T.with_roles("air_spikes") + """, plume AS (SELECT CAST(ts AS DATE) AS date, printf('%02d001', c_nationkey + 1) AS fips FROM events JOIN customer ON c_custkey = user_id WHERE value > 200)
    SELECT fips, date, year, CASE WHEN date IN (SELECT date FROM plume) THEN 'hms' ELSE 'spike_detection' END AS method FROM air_spikes s
    WHERE daily_pm25 > 1.5 * pm25_baseline AND (date NOT IN (SELECT date FROM plume) OR EXISTS (SELECT 1 FROM plume p WHERE p.date = s.date AND p.fips = s.fips))""",
)
def covered_smoke_days(spark, d):
    """Large events stand in for plume hits of the user's county."""
    hits = T.table(spark, d, "events").where("value > 200").join(
        T.table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id")
    ).select(F.to_date("ts").alias("date"), T.county(F.col("c_nationkey"), F.lit(1)).alias("fips"))
    return windows.covered_smoke_days(air_daily(spark, d), hits, hits)


@query(
    "yoy_change",
    T.with_roles("panel") + rounded_sql(
        "SELECT fips, year, (flood_exposure - lag(flood_exposure) OVER w) / lag(flood_exposure) OVER w * 100 AS change FROM panel WINDOW w AS (PARTITION BY fips ORDER BY year)", "change"
    ),
)
def yoy_change(spark, d):
    result = windows.yoy_change(T.panel(spark, d), ["fips"], "flood_exposure", "change").select("fips", "year", "change")
    return rounded(result, "change")


@query(
    "structural_breaks",
    T.with_roles("energy") + """
    SELECT state_fips, year, coalesce(abs(electricity_price_cents_kwh / lag(electricity_price_cents_kwh) OVER (PARTITION BY state_fips ORDER BY year) - 1) > 0.1, false) AS is_break FROM energy""",
)
def structural_breaks(spark, d):
    return windows.structural_breaks(T.energy(spark, d), "state_fips", "electricity_price_cents_kwh").select("state_fips", "year", "is_break")


@query(
    "ffill_bfill",
    T.with_roles("panel") + """
    SELECT fips, year, coalesce(last_value(health_burden IGNORE NULLS) OVER (PARTITION BY fips ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(health_burden IGNORE NULLS) OVER (PARTITION BY fips ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS health_burden FROM panel""",
)
def ffill_bfill(spark, d):
    return windows.fill_within(T.panel(spark, d).select("fips", "year", "health_burden"), "fips", "health_burden")


# --- scalar expressions -------------------------------------------------------------------


@query("degree_days_daily", T.with_roles("good_obs") + rounded_sql("SELECT station_id, date, tmax, hdd, cdd FROM good_obs", "hdd:8 cdd:8"))
def degree_days_daily(spark, d):
    tmax, tmin = F.col("tmax"), F.col("tmin")
    result = good_obs(spark, d).select("station_id", "date", "tmax", C.heating_degrees(tmax, tmin).alias("hdd"), C.cooling_degrees(tmax, tmin).alias("cdd"))
    return rounded(result, "hdd:8 cdd:8")


@query(
    "threshold_exceedance",
    "SELECT event_id, CAST(value > 35 AS INTEGER) AS above_95f, CAST(value > 37.78 AS INTEGER) AS above_100f FROM events",
)
def threshold_exceedance(spark, d):
    return T.table(spark, d, "events").select(
        "event_id", C.exceeds(F.col("value"), P.HEAT_95F_C).alias("above_95f"), C.exceeds(F.col("value"), 37.78).alias("above_100f")
    )


@query(
    "anomaly",
    T.with_roles("station_year", "normal_year") + rounded_sql(
        "SELECT station_id, year, hdd_annual, cdd_annual, hdd_annual - normal_hdd_annual AS hdd_anomaly, cdd_annual - normal_cdd_annual AS cdd_anomaly FROM station_year LEFT JOIN normal_year USING (station_id)",
        "hdd_annual cdd_annual hdd_anomaly cdd_anomaly",
    ),
)
def anomaly(spark, d):
    from hearthline.bindings.joining import _station_anomalies

    return rounded(_station_anomalies(spark, d), "hdd_annual cdd_annual hdd_anomaly cdd_anomaly")


@query("total_damage", T.with_roles("damages") + rounded_sql("SELECT event_id, total_damage FROM damages", "total_damage:4"))
def total_damage(spark, d):
    clamped = clean.clamp_negative(T.storm_events(spark, d), ["property_damage", "crop_damage"])
    result = clamped.select("event_id", C.total_damage(F.col("property_damage"), F.col("crop_damage")).alias("total_damage"))
    return rounded(result, "total_damage:4")


@query("severity_tier", T.with_roles("tiers") + "\nSELECT severity_tier, tier_weight, count(*) AS n, min(total_damage) AS lowest, max(total_damage) AS highest FROM tiers GROUP BY ALL")
def severity_tier(spark, d):
    return K.event_tiers(T.storm_events(spark, d)).groupBy("severity_tier", "tier_weight").agg(
        F.count(F.lit(1)).alias("n"), F.min("total_damage").alias("lowest"), F.max("total_damage").alias("highest")
    )


_AQI_SQL = "CASE WHEN v < 0 THEN NULL " + " ".join(
    f"WHEN v <= {hi} THEN round_even(({ihi - ilo}::DOUBLE / ({hi}::DOUBLE - {lo}::DOUBLE)) * (v - {lo}::DOUBLE) + {ilo}, 0)" for lo, hi, ilo, ihi in P.PM25_BREAKPOINTS
) + " WHEN v IS NOT NULL THEN 500 END"


@query("pm25_to_aqi", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_AQI_SQL} AS aqi FROM (SELECT *, l_extendedprice / 150 - 5 AS v FROM lineitem)")
def pm25_to_aqi(spark, d):
    return T.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.pm25_to_aqi(F.col("l_extendedprice") / 150 - 5).alias("aqi")
    )


@query(
    "weekly_severity",
    T.with_roles("drought_ok") + rounded_sql(
        """SELECT fips, date, (d0_pct + 2 * d1_pct + 3 * d2_pct + 4 * d3_pct + 5 * d4_pct) / 100.0 AS severity, 100 - none_pct AS area,
        CAST(CASE WHEN d4_pct > 0 THEN 4 WHEN d3_pct > 0 THEN 3 WHEN d2_pct > 0 THEN 2 WHEN d1_pct > 0 THEN 1 WHEN d0_pct > 0 THEN 0 ELSE -1 END AS INTEGER) AS level FROM drought_ok""",
        "severity:8 area:8",
    ),
)
def weekly_severity(spark, d):
    weeks = clean.clean_weekly(T.weekly_drought(spark, d))
    result = weeks.select("fips", "date", C.weekly_severity().alias("severity"), (100.0 - F.col("none_pct")).alias("area"), C.highest_drought_level().alias("level"))
    return rounded(result, "severity:8 area:8")


@query(
    "reliability_flag",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND c > 0 THEN CASE WHEN c / o_totalprice > 3 THEN 1 ELSE 0 END WHEN c > 0 THEN 1 ELSE 0 END::INTEGER AS flag FROM (
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_custkey * 1000.0 AS c FROM orders)""",
)
def reliability_flag(spark, d):
    damage = F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).otherwise(F.col("o_totalprice"))
    ratio = C.payout_ratio(F.col("o_custkey") * 1000.0, damage)
    return T.table(spark, d, "orders").select("o_orderkey", C.reliability_flag(ratio, F.lit(10.0)).alias("flag"))


@query("normalize_per_unit", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE round(c_acctbal / c_nationkey, 6) + 0.0 END AS per_unit FROM customer")
def normalize_per_unit(spark, d):
    result = T.table(spark, d, "customer").select("c_custkey", C.per_unit(F.col("c_acctbal"), F.col("c_nationkey")).alias("per_unit"))
    return rounded(result, "per_unit")


@query(
    "flood_risk_class",
    """SELECT p_partkey, CASE WHEN p_size % 10 IN (0, 1, 2, 3, 4, 5) THEN 'high' WHEN p_size % 10 = 6 OR (p_size % 10 = 7 AND p_type = 'ECONOMY') THEN 'moderate' ELSE 'minimal' END AS risk FROM part""",
)
def flood_risk_class(spark, d):
    zone = F.get(F.array(*[F.lit(z) for z in (*P.FLOOD_HIGH, "B", "X", "A99", "D")]), (F.col("p_size") % 10).cast("int"))
    subtype = F.when(F.col("p_type") == "ECONOMY", "0.2 pct annual chance flood hazard")
    return T.table(spark, d, "part").select("p_partkey", C.flood_risk_class(zone, subtype).alias("risk"))


@query(
    "composite_blend",
    T.with_roles("panel") + rounded_sql(
        "SELECT fips, year, 0.7 * CASE WHEN wildfire_score IS NULL THEN 0 ELSE wildfire_score * 0.5 + pm25_annual / 100 * 5 * 0.5 END + 0.3 * drought_score AS score FROM panel", "score:8"
    ),
)
def composite_blend(spark, d):
    static = C.hazard_blend(F.col("wildfire_score"), F.col("pm25_annual"))
    result = T.panel(spark, d).select("fips", "year", C.fire_blend(static, F.col("drought_score")).alias("score"))
    return rounded(result, "score:8")


@query(
    "climate_cost",
    STATE_ROLES + STATE_PANEL_SQL + rounded_sql(
        """SELECT state_fips, year, (5 * hdd_anomaly + 3 * cdd_anomaly) * electricity_price_cents_kwh / 100 AS climate_attributed_energy_cost,
        normalized_consumption * electricity_price_cents_kwh / 100 AS total_energy_cost, 0.25::DOUBLE AS regression_r_squared, 0::BIGINT AS structural_breaks_detected,
        (5 * hdd_anomaly + 3 * cdd_anomaly) / normalized_consumption AS attribution_fraction FROM state_use""",
        "climate_attributed_energy_cost total_energy_cost:4 attribution_fraction:8",
    ),
)
def climate_cost(spark, d):
    panel = state_panel(spark, d)
    breaks = panel.groupBy("state_fips").agg(F.count_if(F.col("year") < 0).alias("structural_breaks_detected"))
    result = K.climate_costs(panel, {"hdd_anomaly": 5.0, "cdd_anomaly": 3.0}, 0.25, breaks)
    return rounded(result, "climate_attributed_energy_cost total_energy_cost:4 attribution_fraction:8")
