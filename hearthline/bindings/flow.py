"""Component transforms and the harmonized panel, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.bindings import tables as T
from hearthline.bindings.registry import query, rounded, rounded_sql
from hearthline.operators import rollups
from hearthline.plans import components as K
from hearthline.plans import harmonize as H
from hearthline.storage import materialize, scratch_path

_DD = "hdd_annual cdd_annual hdd_anomaly cdd_anomaly"
DEGREE_DAYS_SQL = T.with_roles("station_year", "normal_year", "stations") + rounded_sql(
    """SELECT fips, year, avg(hdd_annual) AS hdd_annual, avg(cdd_annual) AS cdd_annual,
    avg(hdd_annual - normal_hdd_annual) AS hdd_anomaly, avg(cdd_annual - normal_cdd_annual) AS cdd_anomaly
    FROM station_year LEFT JOIN normal_year USING (station_id) JOIN stations USING (station_id) GROUP BY ALL""",
    _DD,
)


@query("degree_days", DEGREE_DAYS_SQL)
def degree_days(spark, d):
    result = K.degree_days(T.daily_obs(spark, d), T.station_map(spark, d), T.normals(spark, d), T.MIN_OBS)
    return rounded(result, _DD)


@query(
    "extreme_heat_days",
    T.with_roles("obs", "stations") + rounded_sql(
        f"""SELECT fips, year, avg(a) AS days_above_95f, avg(b) AS days_above_100f FROM (
        SELECT station_id, CAST(year(date) AS INTEGER) AS year, count(*) FILTER (WHERE tmax > CAST(63 AS DOUBLE) * 5 / 9) AS a,
        count(*) FILTER (WHERE tmax > CAST(68 AS DOUBLE) * 5 / 9) AS b FROM obs
        WHERE tmax IS NOT NULL AND coalesce(q_flag_tmax, '') = '' GROUP BY ALL HAVING count(*) >= {T.MIN_OBS})
        JOIN stations USING (station_id) GROUP BY ALL""",
        "days_above_95f days_above_100f",
    ),
)
def extreme_heat(spark, d):
    result = K.extreme_heat(T.daily_obs(spark, d), T.station_map(spark, d), T.MIN_OBS)
    return rounded(result, "days_above_95f days_above_100f")


_TIERS = "total_damage:4"


@query("classify_event_severity", T.with_roles("tiers") + rounded_sql("SELECT * FROM tiers", _TIERS))
def event_tiers(spark, d):
    return rounded(K.event_tiers(T.storm_events(spark, d)), _TIERS)


_UNITS_SQL = """(SELECT s.*, (SELECT arg_min(total_housing_units, abs(h.year - s.year) * 10000 + h.year) FROM housing h WHERE h.fips = s.fips) AS units
    FROM {source} s)"""
_STORM = "storm_severity_score:9 total_damage:2 pct_missing_damage fema_ncei_ratio"


@query(
    "storm_severity",
    T.with_roles("storm_years", "decl", "housing") + rounded_sql(
        """SELECT fips, year, county_severity_raw / nullif(units, 0) AS storm_severity_score, event_count, total_damage,
        CASE WHEN coalesce(ratio, 0) > 3 OR pct_missing_damage > 50 THEN 1 ELSE 0 END AS severity_reliability_flag,
        pct_missing_damage, CASE WHEN ratio = 999 THEN NULL ELSE ratio END AS fema_ncei_ratio
        FROM (SELECT *, CASE WHEN total_damage > 0 AND paid > 0 THEN paid / total_damage
                             WHEN coalesce(total_damage, 0) = 0 AND paid > 0 THEN 999.0 END AS ratio
              FROM (SELECT s.*, coalesce(paid, 0) AS paid FROM """ + _UNITS_SQL.format(source="storm_years") + """ s
                    LEFT JOIN (SELECT fips, year, sum(greatest(ia_amount, 0)) FILTER (WHERE ia_amount IS NOT NULL) AS paid FROM decl GROUP BY ALL) USING (fips, year)))""",
        _STORM,
    ),
)
def storm_severity(spark, d):
    tiered = K.event_tiers(T.storm_events(spark, d))
    return rounded(K.storm_severity(tiered, T.declarations(spark, d), T.housing(spark, d)), _STORM)


_PAID_SQL = """SELECT fips, year, coalesce(sum(greatest(ia_amount, 0)) FILTER (WHERE ia_amount IS NOT NULL), 0) AS total_ia_amount,
    sum(registrant_count) AS registrant_count, count(*) AS ia_events FROM decl GROUP BY ALL"""
_BURDEN = "fema_ia_burden total_ia_amount:2"


@query(
    "fema_ia_burden",
    T.with_roles("decl", "housing") + ", paid AS (" + _PAID_SQL + ")" + rounded_sql(
        "SELECT fips, year, total_ia_amount / nullif(units, 0) AS fema_ia_burden, total_ia_amount, registrant_count, ia_events FROM "
        + _UNITS_SQL.format(source="paid"), _BURDEN,
    ),
)
def payout_burden(spark, d):
    return rounded(K.payout_burden(T.declarations(spark, d), T.housing(spark, d)), _BURDEN)


_DROUGHT = "drought_score pct_area_avg"
_DROUGHT_SQL = """SELECT fips, year, sum((d0_pct + 2 * d1_pct + 3 * d2_pct + 4 * d3_pct + 5 * d4_pct) / 100.0) AS drought_score,
    CAST(max(CASE WHEN d4_pct > 0 THEN 4 WHEN d3_pct > 0 THEN 3 WHEN d2_pct > 0 THEN 2 WHEN d1_pct > 0 THEN 1 WHEN d0_pct > 0 THEN 0 ELSE -1 END) AS INTEGER) AS max_severity,
    count(*) FILTER (WHERE 100.0 - none_pct > 0) AS weeks_in_drought, avg(100.0 - none_pct) AS pct_area_avg FROM drought_ok GROUP BY ALL"""


@query("drought_scores", T.with_roles("drought_ok") + rounded_sql(_DROUGHT_SQL, _DROUGHT))
def drought(spark, d):
    return rounded(K.drought(T.weekly_drought(spark, d)), _DROUGHT)


@query(
    "air_quality_scores",
    T.with_roles("air_spikes") + rounded_sql(
        """SELECT fips, year, avg(daily_pm25) AS pm25_annual_avg, count(*) FILTER (WHERE daily_aqi > 100) AS aqi_unhealthy_days,
        count(*) FILTER (WHERE daily_aqi > 150) AS aqi_very_unhealthy_days,
        count(*) FILTER (WHERE daily_pm25 > 1.5 * pm25_baseline) AS smoke_days, 'spike_detection' AS smoke_day_method
        FROM air_spikes GROUP BY ALL""",
        "pm25_annual_avg",
    ),
)
def air_quality(spark, d):
    return rounded(K.air_quality(T.readings(spark, d), T.monitor_map(spark, d)), "pm25_annual_avg")


_RATES_SQL = """, rates AS (
    SELECT v.fips, v.year, heat_ed_visits / nullif(population, 0) * 100000.0 AS rate FROM county_visits v JOIN census c ON c.fips = v.fips AND c.year = v.year),
    spread AS (SELECT c.fips, c.year, s.heat_ed_visits / nullif(people, 0) * 100000.0 AS rate FROM census c
    JOIN (SELECT substr(fips, 1, 2) AS state_fips, year, sum(population) AS people FROM census GROUP BY ALL) p ON p.state_fips = substr(c.fips, 1, 2) AND p.year = c.year
    JOIN state_visits s ON s.state_fips = p.state_fips AND s.year = p.year),
    merged AS (SELECT * FROM rates WHERE rate IS NOT NULL UNION ALL SELECT * FROM spread ANTI JOIN (SELECT fips, year FROM rates WHERE rate IS NOT NULL) USING (fips, year))"""


@query(
    "health_burden",
    T.with_roles("county_visits", "state_visits", "census") + _RATES_SQL + rounded_sql(
        "SELECT fips, year, rate AS heat_ed_rate_per_100k, rate AS health_burden_index FROM merged",
        "heat_ed_rate_per_100k health_burden_index",
    ),
)
def health_burden(spark, d):
    result = K.health_burden(T.visits(spark, d), T.census(spark, d))
    return rounded(result, "heat_ed_rate_per_100k health_burden_index")


def state_panel(spark, d, with_housing: bool = True):
    """Regression panel of the bound tables."""
    county = T.panel(spark, d)
    anomalies = rollups.state_rollup(
        county.dropna(subset=["hdd_anomaly", "cdd_anomaly"]), means={c: c for c in ("hdd_anomaly", "cdd_anomaly")}
    )
    housing = rollups.state_rollup(T.housing(spark, d), sums={"total_housing_units": "total_housing_units"})
    return K.household_panel(
        T.energy(spark, d), anomalies, rollups.baseline_ratios(T.households(spark, d)), housing if with_housing else None
    )


# Divisions of the states that the bound keys can name.
_DIVISION_SQL = "CASE state_fips " + " ".join(
    f"WHEN '{s}' THEN {n}" for s, n in P.DIVISION_OF_STATE.items()
) + " END"
STATE_PANEL_SQL = ", state_units AS (SELECT substr(fips, 1, 2) AS state_fips, year, sum(total_housing_units) AS total_housing_units FROM housing GROUP BY ALL)," + f"""
    state_raw AS (SELECT e.*, a.hdd_anomaly, a.cdd_anomaly, {_DIVISION_SQL} AS census_division, u.total_housing_units AS found
        FROM energy e JOIN anomalies a USING (state_fips, year) LEFT JOIN state_units u USING (state_fips, year)),
    state_panel AS (SELECT r.* EXCLUDE (found), coalesce(norm_factor, 1.0) AS norm_factor,
        coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY state_fips ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(found IGNORE NULLS) OVER (PARTITION BY state_fips ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS total_housing_units
        FROM state_raw r LEFT JOIN home_ratios USING (census_division)),
    state_use AS (SELECT *, CASE WHEN total_housing_units > 0 THEN electricity_consumption_mwh * 1e6 / total_housing_units ELSE electricity_consumption_mwh * 1e6 END * norm_factor AS normalized_consumption
        FROM state_panel)"""
STATE_ROLES = T.with_roles("energy", "anomalies", "housing", "home_ratios")


@query(
    "per_household_panel",
    STATE_ROLES + STATE_PANEL_SQL + rounded_sql(
        "SELECT state_fips, year, norm_factor, total_housing_units, normalized_consumption, hdd_anomaly, cdd_anomaly FROM state_use",
        "norm_factor normalized_consumption:4 hdd_anomaly:9 cdd_anomaly:9",
    ),
)
def per_household_panel(spark, d):
    result = state_panel(spark, d).select(
        "state_fips", "year", "norm_factor", "total_housing_units", "normalized_consumption", "hdd_anomaly", "cdd_anomaly"
    )
    return rounded(result, "norm_factor normalized_consumption:4 hdd_anomaly:9 cdd_anomaly:9")


# The fit is stated in SQL as the fixed point of demeaning by state and year in turn
# (rows of break years left out), followed by the two-variable normal equations.
_FE_SQL = """, marked AS (SELECT *, coalesce(abs(electricity_price_cents_kwh / lag(electricity_price_cents_kwh) OVER (PARTITION BY state_fips ORDER BY year) - 1) > 0.1, false) AS is_break FROM state_use),
    fe AS (SELECT 0 AS i, state_fips AS s, year AS t, normalized_consumption AS y, hdd_anomaly AS a, cdd_anomaly AS b FROM marked WHERE NOT is_break
    UNION ALL SELECT i + 1, s, t, y - avg(y) OVER (PARTITION BY t), a - avg(a) OVER (PARTITION BY t), b - avg(b) OVER (PARTITION BY t) FROM (
        SELECT i, s, t, y - avg(y) OVER (PARTITION BY s) AS y, a - avg(a) OVER (PARTITION BY s) AS a, b - avg(b) OVER (PARTITION BY s) AS b FROM fe WHERE i < 60)),
    beta AS (SELECT (sum(a * y) * sum(b * b) - sum(b * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)) AS beta_hdd,
        (sum(b * y) * sum(a * a) - sum(a * y) * sum(a * b)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)) AS beta_cdd FROM fe WHERE i = 60),
    within AS (SELECT (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS r2 FROM (
        SELECT corr(y, a) AS r1, corr(y, b) AS r2, corr(a, b) AS r12 FROM (SELECT normalized_consumption - avg(normalized_consumption) OVER w AS y,
        hdd_anomaly - avg(hdd_anomaly) OVER w AS a, cdd_anomaly - avg(cdd_anomaly) OVER w AS b FROM state_use WINDOW w AS (PARTITION BY state_fips))))"""
_FE_ROLES = T.with_roles("energy", "anomalies", "housing", "home_ratios", recursive=True)


@query(
    "two_way_fe_regression",
    _FE_ROLES + STATE_PANEL_SQL + _FE_SQL + "\nSELECT round(beta_hdd, 2) + 0.0 AS beta_hdd, round(beta_cdd, 2) + 0.0 AS beta_cdd FROM beta",
)
def two_way_fe(spark, d):
    from hearthline.operators.regression import two_way_fixed_effects
    from hearthline.operators.windows import structural_breaks

    marked = structural_breaks(state_panel(spark, d), "state_fips", "electricity_price")
    betas = two_way_fixed_effects(marked, "normalized_consumption", ["hdd_anomaly", "cdd_anomaly"], is_break="is_break")
    table = spark.createDataFrame([(betas["hdd_anomaly"], betas["cdd_anomaly"])], "beta_hdd double, beta_cdd double")
    return rounded(table, "beta_hdd:2 beta_cdd:2")


@query(
    "within_r2",
    _FE_ROLES + STATE_PANEL_SQL + _FE_SQL + "\nSELECT round(r2, 6) + 0.0 AS regression_r_squared FROM within",
)
def within_r2(spark, d):
    from hearthline.operators.regression import within_r2 as fit

    return rounded(fit(state_panel(spark, d), "normalized_consumption", "hdd_anomaly", "cdd_anomaly"), "regression_r_squared")


_ENERGY = "climate_attributed_energy_cost:1 total_energy_cost:2 attribution_fraction:4 regression_r_squared"
_COST_SQL = """, costs AS (SELECT m.state_fips, m.year, (beta_hdd * hdd_anomaly + beta_cdd * cdd_anomaly) * electricity_price_cents_kwh / 100.0 AS climate,
    normalized_consumption * electricity_price_cents_kwh / 100.0 AS total, r2, n FROM marked m, beta, within, (SELECT state_fips, CAST(count(*) FILTER (WHERE is_break) AS INTEGER) AS n FROM marked GROUP BY ALL) k
    WHERE k.state_fips = m.state_fips)"""


@query(
    "energy_attribution",
    _FE_ROLES + STATE_PANEL_SQL + _FE_SQL + _COST_SQL + rounded_sql(
        """SELECT p.fips, p.year, climate AS climate_attributed_energy_cost, total AS total_energy_cost,
        CASE WHEN total <> 0 THEN climate / total ELSE 0 END AS attribution_fraction, r2 AS regression_r_squared, n AS structural_breaks_detected
        FROM panel p JOIN costs c ON c.state_fips = substr(p.fips, 1, 2) AND c.year = p.year""",
        _ENERGY,
    ),
)
def energy_attribution(spark, d):
    result = K.energy_attribution(T.energy(spark, d), T.households(spark, d), T.panel(spark, d), T.housing(spark, d))
    return rounded(result, _ENERGY)


@query(
    "storm_events_clean",
    """WITH cross_ AS (SELECT l_orderkey, printf('%02d%03d', s_nationkey + 1, s_suppkey) AS fips, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS f
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, s_nationkey, s_suppkey),
    o AS (SELECT *, o_totalprice AS damage FROM orders),
    county AS (SELECT CAST(o_orderkey AS VARCHAR) AS event_id, printf('%02d%03d', c_nationkey + 1, 7) AS fips, CAST(o_orderdate AS DATE) AS date,
        o_orderpriority AS event_type, floor(damage / 1000) * 1000.0 AS property_damage, 0.0::DOUBLE AS crop_damage, 3.0::DOUBLE AS injuries_direct
        FROM o JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
    zone AS (SELECT CASE WHEN count(*) OVER w > 1 THEN concat(o_orderkey, '_z', row_number() OVER (PARTITION BY o_orderkey ORDER BY fips) - 1) ELSE CAST(o_orderkey AS VARCHAR) END AS event_id,
        fips, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS event_type, floor(damage / 1000) * 1000.0 * f AS property_damage, 0.0::DOUBLE AS crop_damage, 3.0 * f AS injuries_direct
        FROM o JOIN cross_ ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' WINDOW w AS (PARTITION BY o_orderkey))"""
    + rounded_sql("SELECT * FROM county UNION ALL SELECT * FROM zone", "property_damage:3 injuries_direct"),
)
def storm_events_clean(spark, d):
    """Orders as raw event details: county (F), zone (O) and marine (P) records."""
    orders = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "c").when(F.col("o_orderstatus") == "O", " Z ").otherwise("M")
    text = lambda c: c.cast("string")
    # A zone's last three digits are its number and all before them its state, so numbers of any length come together again.
    key = F.col("o_orderkey")
    zone = F.col("o_orderstatus") == "O"
    details = orders.select(
        text(F.col("o_orderkey")).alias("EVENT_ID"),
        F.when(zone, text(F.floor(key / 1000))).otherwise(text(F.col("c_nationkey") + 1)).alias("STATE_FIPS"),
        kind.alias("CZ_TYPE"),
        F.when(zone, text(key % 1000)).otherwise(F.lit("7")).alias("CZ_FIPS"),
        F.date_format("o_orderdate", "yyyyMM").alias("BEGIN_YEARMONTH"),
        text(F.dayofmonth("o_orderdate")).alias("BEGIN_DAY"),
        F.col("o_orderpriority").alias("EVENT_TYPE"),
        F.concat(text(F.floor(F.col("o_totalprice") / 1000)), F.lit("K")).alias("DAMAGE_PROPERTY"),
        F.lit("").alias("DAMAGE_CROPS"), F.lit("3").alias("INJURIES_DIRECT"), F.lit("x").alias("DEATHS_DIRECT"),
        F.lit(None).cast("string").alias("MAGNITUDE"),
    )
    places = orders.select(text(F.col("o_orderkey")).alias("EVENT_ID"), F.lit(1.0).alias("LATITUDE"), F.lit(2.0).alias("LONGITUDE"))
    zones = T.zone_crosswalk(spark, d).withColumn("zone_id", F.format_string("%05d", F.col("zone_id").cast("long")))
    events = K.storm_events(details, places, zones)
    result = events.select("event_id", "fips", "date", "event_type", "property_damage", "crop_damage", "injuries_direct")
    return rounded(result, "property_damage:3 injuries_direct")


def component_tables(spark, d) -> dict:
    """Yearly component tables cut from the bound panel, as a transform run leaves them."""
    panel = materialize(T.panel(spark, d), "panel")
    pick = lambda source, *columns: panel.select("fips", "year", *columns)
    return {
        "degree_days": panel.select(
            "fips", "year", F.when(F.col("extreme_heat_days") > 0, F.col("hdd_anomaly")).alias("hdd_anomaly"), "cdd_anomaly",
            (F.col("hdd_anomaly") + 1000.0).alias("hdd_annual"), F.col("cdd_anomaly").alias("cdd_annual"),
        ),
        "extreme_heat": panel.select("fips", "year", F.col("extreme_heat_days").alias("days_above_95f")).where("year > 1995"),
        "storm_severity": panel.select("fips", "year", F.col("storm_severity").alias("storm_severity_score")),
        "air_quality_scoring": panel.where(F.col("wildfire_score").isNotNull()).select(
            "fips", "year", F.col("pm25_annual").alias("pm25_annual_avg"), "aqi_unhealthy_days"
        ),
        "flood_zone_scoring": panel.where(F.col("year") == T.SCORING_YEAR).select(
            "fips", "year", "flood_exposure", F.lit(1).alias("map_currency_flag")
        ),
        "wildfire_scoring": pick("wildfire", "wildfire_score"),
        "drought_scoring": pick("drought", "drought_score"),
        "energy_attribution": panel.select("fips", "year", F.col("energy_cost_attributed").alias("climate_attributed_energy_cost")),
        "health_burden": panel.where(F.col("health_burden").isNotNull()).select(
            "fips", "year", F.col("health_burden").alias("health_burden_index")
        ),
        "fema_ia_burden": panel.where(F.col("fema_ia_burden").isNotNull()).select(
            "fips", "year", "fema_ia_burden", F.col("fema_ia_burden").alias("total_ia_amount")
        ),
    }


MERGED_SQL = """merged AS (SELECT fips, year, CASE WHEN extreme_heat_days > 0 THEN hdd_anomaly END AS hdd_anomaly, cdd_anomaly,
    CASE WHEN year > 1995 THEN extreme_heat_days END AS extreme_heat_days, storm_severity,
    CASE WHEN wildfire_score IS NOT NULL THEN pm25_annual END AS pm25_annual,
    CASE WHEN wildfire_score IS NOT NULL THEN aqi_unhealthy_days END AS aqi_unhealthy_days,
    CASE WHEN year = 2000 THEN flood_exposure END AS flood_exposure, wildfire_score, drought_score, energy_cost_attributed, health_burden, fema_ia_burden FROM panel)"""


@query(
    "full_outer_merge",
    T.with_roles("panel") + ", " + MERGED_SQL + "\nSELECT * FROM merged",
)
def full_outer_merge(spark, d):
    return H.merge_components(component_tables(spark, d)).select("fips", "year", *T.COMPONENTS)


def centroids(spark, d):
    """County centres: one place per supplier number, from the embeddings."""
    places = T.points(spark, d).select(F.col("fips").cast("long").alias("l_suppkey"), "lat", "lon")
    return T.suppliers(spark, d).join(places, "l_suppkey").select("fips", "lat", "lon")


CENTROIDS_SQL = """centroids AS (SELECT sup.fips, lat, lon FROM sup JOIN places ON CAST(places.fips AS BIGINT) = sup.l_suppkey)"""
IDW_SQL = """gaps AS (SELECT year, component FROM (SELECT year, component, count(value) AS v, count(*) AS n FROM measured GROUP BY ALL) WHERE v >= n * 0.1 AND v < n),
    near AS (SELECT q.year, q.component, q.fips, s.value, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(sc.lat - qc.lat) / 2), 2) + cos(radians(qc.lat)) * cos(radians(sc.lat)) * pow(sin(radians(sc.lon - qc.lon) / 2), 2)))) AS km, s.fips AS neighbour
        FROM measured q JOIN gaps USING (year, component) JOIN centroids qc ON qc.fips = q.fips
        JOIN measured s ON s.year = q.year AND s.component = q.component AND s.value IS NOT NULL JOIN centroids sc ON sc.fips = s.fips WHERE q.value IS NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY year, component, fips ORDER BY km, neighbour) AS place FROM near
        WHERE km <= CASE WHEN component IN ('pm25_annual', 'aqi_unhealthy_days') THEN 100 ELSE 200 END),
    filled AS (SELECT year, component, fips, coalesce(avg(value) FILTER (WHERE km = 0), sum(value / (km * km)) / sum(1 / (km * km))) AS estimate, min(km) AS nearest_km
        FROM ranked WHERE place <= 8 GROUP BY ALL)"""
MEASURED_SQL = """measured AS (SELECT fips, year, u.component, u.value FROM merged, LATERAL (VALUES ('hdd_anomaly', hdd_anomaly), ('cdd_anomaly', cdd_anomaly),
    ('extreme_heat_days', extreme_heat_days), ('pm25_annual', pm25_annual), ('aqi_unhealthy_days', aqi_unhealthy_days)) u(component, value))"""


@query(
    "idw_gap_fill",
    T.with_roles("panel", "places") + ", " + ",\n".join([MERGED_SQL, CENTROIDS_SQL, MEASURED_SQL, IDW_SQL]) + rounded_sql(
        """SELECT m.fips, m.year, coalesce(m.pm25_annual, f.estimate) AS pm25_annual, m.pm25_annual IS NULL AND f.estimate IS NOT NULL AS gap_filled,
        CASE WHEN m.pm25_annual IS NULL THEN f.nearest_km END AS nearest_km FROM merged m LEFT JOIN filled f ON f.fips = m.fips AND f.year = m.year AND f.component = 'pm25_annual'""",
        "pm25_annual nearest_km",
    ),
)
def idw_gap_fill(spark, d):
    merged = H.merge_components(component_tables(spark, d)).select("fips", "year", *T.COMPONENTS)
    filled = H.idw_gap_fill(merged, centroids(spark, d))
    result = filled.select(
        "fips", "year", "pm25_annual", F.col("pm25_annual__gap_filled").alias("gap_filled"),
        F.col("pm25_annual__nearest_monitor_km").alias("nearest_km"),
    )
    return rounded(result, "pm25_annual nearest_km")


_HARMONIZED = "hdd_anomaly extreme_heat_days pm25_annual aqi_unhealthy_days health_burden fema_ia_burden"
_LATEST = "(SELECT fips, arg_max(health_burden, year) AS latest FROM merged WHERE health_burden IS NOT NULL GROUP BY fips)"


@query(
    "harmonize",
    T.with_roles("panel", "places") + ", " + ",\n".join([MERGED_SQL, CENTROIDS_SQL, MEASURED_SQL, IDW_SQL]) + rounded_sql(
        f"""SELECT m.fips, m.year, coalesce(m.hdd_anomaly, f1.estimate) AS hdd_anomaly, coalesce(m.extreme_heat_days, f2.estimate) AS extreme_heat_days,
        coalesce(m.pm25_annual, f3.estimate) AS pm25_annual, coalesce(m.aqi_unhealthy_days, f4.estimate) AS aqi_unhealthy_days, m.flood_exposure,
        CASE WHEN m.year = 2000 THEN coalesce(m.health_burden, latest) ELSE m.health_burden END AS health_burden,
        coalesce(m.fema_ia_burden, 0) AS fema_ia_burden,
        CASE WHEN m.pm25_annual IS NOT NULL OR f3.estimate IS NULL THEN 'A' WHEN f3.nearest_km > 50 THEN 'C' ELSE 'B' END AS pm25_grade,
        CASE WHEN m.year = 2000 AND m.health_burden IS NULL AND latest IS NOT NULL THEN 'C' ELSE 'B' END AS health_grade
        FROM merged m LEFT JOIN {_LATEST} USING (fips)
        """ + " ".join(
            f"LEFT JOIN filled f{i} ON f{i}.fips = m.fips AND f{i}.year = m.year AND f{i}.component = '{c}'"
            for i, c in enumerate(("hdd_anomaly", "extreme_heat_days", "pm25_annual", "aqi_unhealthy_days"), 1)
        ),
        _HARMONIZED,
    ),
)
def harmonize(spark, d):
    panel = H.harmonize(component_tables(spark, d), T.SCORING_YEAR, centroids(spark, d))
    result = panel.select(
        "fips", "year", "hdd_anomaly", "extreme_heat_days", "pm25_annual", "aqi_unhealthy_days", "flood_exposure",
        "health_burden", "fema_ia_burden", F.col("pm25_annual__confidence").alias("pm25_grade"),
        F.col("health_burden__confidence").alias("health_grade"),
    )
    return rounded(result, _HARMONIZED)


@query(
    "component_count",
    T.with_roles("panel") + ", " + MERGED_SQL + "\nSELECT fips, year, CAST("
    + " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in P.COMPONENT_IDS)
    + " AS INTEGER) AS component_count, 'A' AS hdd_confidence, 'attributed' AS hdd_attribution FROM merged",
)
def component_count(spark, d):
    panel = H.add_provenance(H.merge_components(component_tables(spark, d)))
    return panel.select(
        "fips", "year", "component_count", F.col("hdd_anomaly__confidence").alias("hdd_confidence"),
        F.col("hdd_anomaly__attribution").alias("hdd_attribution"),
    )


@query(
    "zero_fill_payout",
    T.with_roles("panel") + ", " + MERGED_SQL + "\nSELECT fips, year, coalesce(fema_ia_burden, 0) AS fema_ia_burden, coalesce(fema_ia_burden, 0) AS total_ia_amount FROM merged",
)
def zero_fill_payout(spark, d):
    panel = H.zero_fill_payout(H.add_provenance(H.merge_components(component_tables(spark, d))))
    return panel.select("fips", "year", "fema_ia_burden", F.col("fema_ia_burden__total_ia_amount").alias("total_ia_amount"))


@query(
    "carry_forward_latest",
    T.with_roles("panel") + ", " + MERGED_SQL + f"\nSELECT fips, year, CASE WHEN year = 2000 THEN coalesce(health_burden, latest) ELSE health_burden END AS health_burden FROM merged LEFT JOIN {_LATEST} USING (fips)",
)
def carry_forward(spark, d):
    panel = H.carry_forward_health(H.add_provenance(H.merge_components(component_tables(spark, d))), T.SCORING_YEAR)
    return panel.select("fips", "year", "health_burden")


@query(
    "downgrade_by_distance",
    T.with_roles("panel", "places") + ", " + ",\n".join([MERGED_SQL, CENTROIDS_SQL, MEASURED_SQL, IDW_SQL]) + """
    SELECT m.fips, m.year, CASE WHEN m.pm25_annual IS NOT NULL OR f.estimate IS NULL THEN 'A' WHEN f.nearest_km > 50 THEN 'C' ELSE 'B' END AS pm25_grade,
    CASE WHEN m.extreme_heat_days IS NULL AND g.estimate IS NOT NULL THEN 'B' ELSE 'A' END AS heat_grade
    FROM merged m LEFT JOIN filled f ON f.fips = m.fips AND f.year = m.year AND f.component = 'pm25_annual'
    LEFT JOIN filled g ON g.fips = m.fips AND g.year = m.year AND g.component = 'extreme_heat_days'""",
)
def downgrade_by_distance(spark, d):
    panel = H.idw_gap_fill(H.add_provenance(H.merge_components(component_tables(spark, d))), centroids(spark, d))
    graded = H.downgrade_by_distance(panel)
    return graded.select(
        "fips", "year", F.col("pm25_annual__confidence").alias("pm25_grade"),
        F.col("extreme_heat_days__confidence").alias("heat_grade"),
    )


@query(
    "sort_output",
    T.with_roles("panel") + "\nSELECT fips, year, storm_severity FROM panel ORDER BY fips, year",
)
def sort_output(spark, d):
    return H.sort_output(T.panel(spark, d).select("fips", "year", "storm_severity"))


@query(
    "incremental_year_load",
    """SELECT CAST(year(ts) AS INTEGER) AS year, event_type, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM events GROUP BY ALL""",
)
def incremental_year_load(spark, d):
    """The event file arrives as a stream, twice; the second run finds nothing new."""
    from hearthline.streaming.incremental import incremental_year_load as load

    schema = T.table(spark, d, "events").schema
    target, checkpoint = scratch_path(spark, "events"), scratch_path(spark, "checkpoint")
    add_year = lambda df: df.withColumn("year", F.year("ts"))
    for _ in range(2):
        load(spark, d, schema, target, checkpoint, add_year, pattern="events.parquet")
    loaded = spark.read.parquet(target)
    result = loaded.groupBy("year", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(result, "total:2")


