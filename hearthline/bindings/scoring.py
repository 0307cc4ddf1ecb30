"""The scoring steps on the bound panel, one query per step and for the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.bindings import tables as T
from hearthline.bindings.registry import query, rounded, rounded_sql
from hearthline.functions import columns as C
from hearthline.operators import rollups, stats, windows
from hearthline.operators.order_stats import quantiles, with_rank
from hearthline.plans import index as I
from hearthline.storage import materialize

YEAR = T.SCORING_YEAR
_PLACE = I.precedence()
_TOTAL = sum(c.weight for c in P.REGISTRY)
REG_SQL = "reg(component, pos, place, weight, kind, span) AS (VALUES " + ", ".join(
    f"('{c.id}', {i}, {_PLACE[c.id]}, {c.weight}::DOUBLE / {_TOTAL}::DOUBLE, '{c.transform}', {c.window})"
    for i, c in enumerate(P.REGISTRY)
) + ")"
STEP_SQL = {
    "universe": f"""universe AS (SELECT fips FROM panel WHERE year = {YEAR} AND (hdd_anomaly IS NOT NULL OR cdd_anomaly IS NOT NULL)
        AND drought_score IS NOT NULL AND storm_severity IS NOT NULL)""",
    "trans": f"""trans AS (SELECT fips, component, CASE WHEN kind = 'log' AND value >= 0 THEN ln(1 + value)
        WHEN kind = 'sqrt' THEN sign(value) * sqrt(abs(value)) ELSE value END AS value FROM panel_long JOIN reg USING (component) WHERE year = {YEAR})""",
    "wins": """wins AS (SELECT fips, component, least(value, cut) AS value FROM trans
        JOIN (SELECT component, quantile_cont(value, 0.99) AS cut FROM trans GROUP BY component) USING (component))""",
    "centered": """centered AS (SELECT fips, component, (rank() OVER (PARTITION BY component ORDER BY value) + (count(*) OVER (PARTITION BY component, value) - 1) / 2.0)
        / count(*) OVER (PARTITION BY component) * 100.0 - 50.0 AS value FROM wins SEMI JOIN universe USING (fips))""",
    "pairs": """pairs AS (SELECT x.component AS a, y.component AS b, CASE WHEN var_pop(x.value) > 0 AND var_pop(y.value) > 0 THEN corr(x.value, y.value) END AS r, count(*) AS n FROM centered x JOIN reg rx ON rx.component = x.component
        JOIN centered y ON y.fips = x.fips JOIN reg ry ON ry.component = y.component WHERE rx.pos < ry.pos GROUP BY ALL)""",
    "flagged": """flagged AS (SELECT CASE WHEN ra.place <= rb.place THEN a ELSE b END AS winner, CASE WHEN ra.place <= rb.place THEN b ELSE a END AS loser, r, 1 - r * r AS raw_penalty
        FROM pairs JOIN reg ra ON ra.component = a JOIN reg rb ON rb.component = b WHERE round(abs(r), 12) > 0.6)""",
    "penalties": """penalties AS (SELECT loser AS component, greatest(0.2, product(raw_penalty)) AS penalty FROM flagged GROUP BY loser)""",
    "win_points": f"""win_points AS (SELECT fips, component, year, value, span FROM panel_long JOIN reg USING (component) WHERE year BETWEEN {YEAR} - span + 1 AND {YEAR})""",
    "slopes": """slopes AS (SELECT fips, component, CASE WHEN years < 2 THEN 0 WHEN n >= greatest(2, ceil(span * 0.8)) THEN slope END AS slope FROM
        (SELECT fips, component, span, count(*) AS n FROM win_points GROUP BY ALL) JOIN (SELECT component, count(DISTINCT year) AS years FROM win_points GROUP BY ALL) USING (component)
        LEFT JOIN (SELECT p.fips, p.component, median((q.value - p.value) / (q.year - p.year)) AS slope FROM win_points p JOIN win_points q ON q.fips = p.fips AND q.component = p.component AND q.year > p.year GROUP BY ALL) USING (fips, component))""",
    "accel": """accel AS (SELECT fips, component, slope, least(3.0, greatest(0.5, CASE WHEN sigma > 0 THEN coalesce(CASE WHEN abs(med) >= 0.1 * sigma THEN slope / med ELSE 1 + (slope - med) / sigma END, 1) ELSE 1 END)) AS acceleration
        FROM slopes JOIN (SELECT component, median(slope) AS med, stddev_samp(slope) AS sigma FROM slopes GROUP BY component) USING (component))""",
    "parts": """parts AS (SELECT fips, component, value * coalesce(penalty, 1) * coalesce(acceleration, 1) AS value FROM centered LEFT JOIN penalties USING (component) LEFT JOIN accel USING (fips, component))""",
    "comp_scores": """comp_scores AS (SELECT fips, component, value * weight AS score FROM parts JOIN reg USING (component))""",
    "raw": """raw AS (SELECT fips, sum(score) AS raw_composite FROM comp_scores GROUP BY fips)""",
    "kval": """kval AS (SELECT CASE WHEN q3 - q1 < 1e-10 THEN 1 ELSE 40 / (q3 - q1) END AS k FROM (SELECT quantile_cont(raw_composite, 0.25) AS q1, quantile_cont(raw_composite, 0.75) AS q3 FROM raw))""",
    "scores": """scores AS (SELECT fips, 100 + k * raw_composite AS index_score, raw_composite FROM raw, kval)""",
}


def steps(upto: str, *roles: str, recursive: bool = False) -> str:
    """``WITH`` clause with the roles and the index steps up to ``upto``."""
    names = list(STEP_SQL)
    chain = [STEP_SQL[n] for n in names[: names.index(upto) + 1]]
    return T.with_roles("panel_long", *roles, recursive=recursive) + ",\n" + ",\n".join([REG_SQL, *chain])


def current(spark, d):
    """Scoring-year slice, stored as the harmonized panel would be."""
    return materialize(I.with_scenario(T.panel(spark, d).where(F.col("year") == YEAR)), "current")


def centered(spark, d):
    """Centered values."""
    stored = current(spark, d)
    return I.center(I.percentile_rank(I.winsorized_universe(stored, T.SETTINGS)))


def plain(df):
    return df.drop("scenario")


@query(
    "component_registry",
    T.with_roles("panel_long") + ", " + REG_SQL + rounded_sql(
        """SELECT component, pos AS position, weight, kind AS transform, span AS window, n AS n_observed, m * weight AS weighted_mean
        FROM reg JOIN (SELECT component, count(*) AS n, avg(value) AS m FROM panel_long GROUP BY component) USING (component)""",
        "weight weighted_mean",
    ),
)
def component_registry(spark, d):
    """The registry applied to the panel: observed cells and weighted mean per component."""
    long = T.panel(spark, d).unpivot(["fips", "year"], T.COMPONENTS, "component", "value")
    observed = long.groupBy("component").agg(F.count("value").alias("n_observed"), F.avg("value").alias("mean"))
    result = P.registry_frame(spark).join(observed, "component").select(
        "component", "position", "weight", "transform", "window", "n_observed",
        (F.col("mean") * F.col("weight")).alias("weighted_mean"),
    )
    return rounded(result, "weight weighted_mean")


@query("transform_inputs", steps("trans") + rounded_sql("SELECT fips, component, value FROM trans", "value"))
def transform_inputs(spark, d):
    long = I.observed_long(I.transform_inputs(current(spark, d)), T.COMPONENTS)
    return rounded(long.select("fips", "component", "value"), "value")


@query("winsorize_upper", steps("wins") + rounded_sql("SELECT fips, component, value FROM wins", "value"))
def winsorize(spark, d):
    long = I.observed_long(I.transform_inputs(current(spark, d)), T.COMPONENTS).select("scenario", "fips", "component", "value")
    return rounded(plain(windows.winsorize_upper(long, ["scenario", "component"], 99.0)), "value")


@query("define_universe", steps("universe") + "\nSELECT fips FROM universe")
def define_universe(spark, d):
    return I.define_universe(current(spark, d)).select("fips")


@query(
    "percentile_rank_average", steps("centered") + rounded_sql("SELECT fips, component, value + 50 AS pct FROM centered", "pct")
)
def percentile_rank(spark, d):
    ranked = I.percentile_rank(I.winsorized_universe(current(spark, d), T.SETTINGS))
    return rounded(ranked.select("fips", "component", F.col("value").alias("pct")), "pct")


@query("center", steps("centered") + rounded_sql("SELECT fips, component, value FROM centered", "value"))
def center(spark, d):
    return rounded(plain(centered(spark, d)), "value")


def pairs(spark, d):
    return stats.pearson_pairs(I.to_wide(centered(spark, d), T.COMPONENTS), ["scenario"], T.COMPONENTS)


@query("pearson_matrix", steps("pairs") + rounded_sql("SELECT a, b, r, n FROM pairs", "r"))
def pearson_matrix(spark, d):
    return rounded(plain(pairs(spark, d)), "r")


@query(
    "correlation_matrix_wide",
    steps("pairs") + rounded_sql(
        "SELECT component, " + ", ".join(f"max(r) FILTER (WHERE other = '{c}') AS {c}" for c in P.COMPONENT_IDS) + """ FROM (
        SELECT a AS component, b AS other, r FROM pairs UNION ALL SELECT b, a, r FROM pairs UNION ALL SELECT component, component, 1.0 FROM reg) GROUP BY component""",
        " ".join(P.COMPONENT_IDS),
    ),
)
def correlation_matrix(spark, d):
    wide = stats.full_matrix(pairs(spark, d), ["scenario"], T.COMPONENTS)
    return rounded(plain(wide), " ".join(T.COMPONENTS))


@query(
    "flagged_pairs", steps("flagged") + rounded_sql("SELECT winner, loser, r, raw_penalty FROM flagged", "r raw_penalty")
)
def flagged_pairs(spark, d):
    return rounded(plain(I.flagged_pairs(pairs(spark, d), 0.6)), "r raw_penalty")


@query("overlap_penalties", steps("penalties") + rounded_sql("SELECT component, penalty FROM penalties", "penalty"))
def overlap_penalties(spark, d):
    return rounded(plain(I.overlap_penalties(I.flagged_pairs(pairs(spark, d), 0.6), 0.2)), "penalty")


def slopes(spark, d):
    wide = I.with_scenario(T.panel(spark, d))
    long = wide.unpivot([*I.UNIT, "year"], T.COMPONENTS, "component", "value")
    return windows.theil_sen(long, P.registry_frame(spark), YEAR, I.UNIT)


@query("theil_sen_slope", steps("slopes") + rounded_sql("SELECT fips, component, slope FROM slopes", "slope:9"))
def theil_sen(spark, d):
    return rounded(plain(slopes(spark, d)), "slope:9")


@query(
    "acceleration_multiplier",
    steps("accel") + rounded_sql("SELECT fips, component, slope, acceleration FROM accel", "slope:9 acceleration:9"),
)
def acceleration(spark, d):
    return rounded(plain(windows.acceleration_multipliers(slopes(spark, d), ["scenario"], 0.5, 3.0, 0.1)), "slope:9 acceleration:9")


@query(
    "acceleration_distribution",
    steps("accel") + rounded_sql(
        """SELECT component, median(acceleration) AS median_acceleration, avg(CASE WHEN acceleration = 0.5 THEN 100.0 ELSE 0 END) AS pct_at_lower_bound,
        avg(CASE WHEN acceleration = 3.0 THEN 100.0 ELSE 0 END) AS pct_at_upper_bound FROM accel GROUP BY component""",
        "median_acceleration pct_at_lower_bound pct_at_upper_bound",
    ),
)
def acceleration_distribution(spark, d):
    accel = windows.acceleration_multipliers(slopes(spark, d), ["scenario"], 0.5, 3.0, 0.1)
    result = rollups.acceleration_distribution(accel, ["scenario", "component"], 0.5, 3.0)
    return rounded(plain(result), "median_acceleration pct_at_lower_bound pct_at_upper_bound")


@query(
    "impute_and_downgrade",
    T.with_roles("panel") + f"""
    SELECT fips, coalesce(wildfire_score, 0) AS wildfire_score, coalesce(health_burden, 0) AS health_burden, hdd_anomaly,
    CASE WHEN wildfire_score IS NULL THEN 'C' ELSE 'B' END AS fire_grade, CASE WHEN extreme_heat_days > 8 THEN 'B' ELSE 'A' END AS flood_grade
    FROM panel WHERE year = {YEAR}""",
)
def impute(spark, d):
    marked = current(spark, d).withColumns(
        {
            "wildfire_score__confidence": F.lit("B"),
            "flood_exposure__confidence": F.lit("A"),
            "flood_exposure__map_currency_flag": F.when(F.col("extreme_heat_days") > 8, 1).otherwise(0),
        }
    )
    return I.impute_and_downgrade(marked).select(
        "fips", "wildfire_score", "health_burden", "hdd_anomaly",
        F.col("wildfire_score__confidence").alias("fire_grade"), F.col("flood_exposure__confidence").alias("flood_grade"),
    )


@query(
    "quality_tier",
    T.with_roles("panel") + f"""
    SELECT fips, year, CASE WHEN (aqi_unhealthy_days > 8 AND pm25_annual > 4) OR
        (wildfire_score IS NULL)::INT + (health_burden IS NULL)::INT + (fema_ia_burden IS NULL)::INT >= 3 THEN 'bronze'
        WHEN aqi_unhealthy_days > 8 OR extreme_heat_days > 12 THEN 'silver' ELSE 'gold' END AS data_quality_tier FROM panel""",
)
def quality_tier(spark, d):
    marked = T.panel(spark, d).withColumns(
        {
            "pm25_annual__gap_filled": F.col("aqi_unhealthy_days") > 8,
            "pm25_annual__nearest_monitor_km": F.col("pm25_annual") * 12.5,
            "extreme_heat_days__gap_filled": F.col("extreme_heat_days") > 12,
        }
    )
    return marked.select("fips", "year", C.quality_tier(marked.columns).alias("data_quality_tier"))


def ready(spark, d):
    return I.prepare(T.panel(spark, d), T.SETTINGS)


def scored_parts(spark, d):
    base = ready(spark, d)
    weights = P.registry_frame(spark).select("component", "weight")
    parts = I.component_scores(I.contributions(base.centered, base.penalties, base.accelerations), weights)
    return parts, base


@query("component_scores", steps("comp_scores") + rounded_sql("SELECT fips, component, score FROM comp_scores", "score"))
def component_scores(spark, d):
    return rounded(plain(scored_parts(spark, d)[0]), "score")


@query("quantile_calibration", steps("kval") + rounded_sql("SELECT k FROM kval", "k"))
def quantile_calibration(spark, d):
    parts, _ = scored_parts(spark, d)
    raw = parts.groupBy(*I.UNIT).agg(F.sum("score").alias("raw_composite"))
    return rounded(plain(rollups.calibrate_k(raw, ["scenario"], "raw_composite", 40.0)), "k")


@query("composite_and_scale", steps("scores") + rounded_sql("SELECT * FROM scores", "index_score raw_composite"))
def composite(spark, d):
    parts, _ = scored_parts(spark, d)
    return rounded(plain(I.composite(parts, T.SETTINGS)[0]), "index_score raw_composite")


INDEX_SQL = steps("scores") + rounded_sql(
    f"""SELECT s.fips, index_score, raw_composite, CASE WHEN (wildfire_score IS NULL)::INT + (health_burden IS NULL)::INT + (fema_ia_burden IS NULL)::INT
    + (pm25_annual IS NULL)::INT >= 3 THEN 'bronze' ELSE 'gold' END AS data_quality_tier
    FROM scores s JOIN panel p ON p.fips = s.fips AND p.year = {YEAR}""",
    "index_score raw_composite",
)


@query("compute_index", INDEX_SQL)
def compute_index(spark, d):
    result = I.compute_index(T.panel(spark, d), T.SETTINGS)
    return rounded(plain(result.scores), "index_score raw_composite")


@query(
    "index_national_strain_dollar",
    steps("scores", "census") + f""", inc AS (SELECT fips, total_housing_units, median_household_income FROM census WHERE year = {YEAR}),
    ratio AS (SELECT s.fips, index_score / median_household_income AS v FROM scores s JOIN inc USING (fips) WHERE median_household_income > 0)"""
    + rounded_sql(
        f"""SELECT s.fips, v / (SELECT median(v) FROM ratio) * 100 AS index_strain, energy_cost_attributed AS index_dollar,
        (SELECT sum(total_housing_units * raw_composite) / sum(total_housing_units) FROM scores JOIN inc USING (fips) WHERE total_housing_units > 0) AS national
        FROM scores s JOIN ratio USING (fips) JOIN panel p ON p.fips = s.fips AND p.year = {YEAR}""",
        "index_strain national",
    ),
)
def national_strain_dollar(spark, d):
    census = T.census(spark, d).where(F.col("year") == YEAR)
    result = I.compute_index(T.panel(spark, d), T.SETTINGS, census)
    joined = result.strain.join(result.dollar, I.UNIT).join(result.national, "scenario")
    return rounded(joined.select("fips", "index_strain", "index_dollar", "national"), "index_strain national")


@query(
    "strain",
    T.with_roles("panel", "census") + f", ratio AS (SELECT fips, year, storm_severity / median_household_income AS v FROM panel JOIN census USING (fips, year))"
    + rounded_sql("SELECT fips, CAST(year AS VARCHAR) AS scenario, v / median(v) OVER (PARTITION BY year) * 100 AS index_strain FROM ratio", "index_strain"),
)
def strain(spark, d):
    """Every year of the panel is its own scenario; storm severity stands in for the score."""
    scores = T.panel(spark, d).select(
        F.col("year").cast("string").alias("scenario"), F.concat_ws("/", "fips", "year").alias("fips"),
        F.col("storm_severity").alias("index_score"),
    )
    income = T.census(spark, d).select(F.concat_ws("/", "fips", "year").alias("fips"), "median_household_income")
    result = I.strain(scores, income).select(F.split_part("fips", F.lit("/"), F.lit(1)).alias("fips"), "scenario", "index_strain")
    return rounded(result, "index_strain")


@query(
    "dollar_passthrough", steps("universe") + f"\nSELECT fips, energy_cost_attributed AS index_dollar FROM panel SEMI JOIN universe USING (fips) WHERE year = {YEAR}"
)
def dollar(spark, d):
    return plain(I.compute_index(T.panel(spark, d), T.SETTINGS).dollar)


@query(
    "weighted_mean_national",
    T.with_roles("panel", "census") + rounded_sql(
        "SELECT year, sum(total_housing_units * storm_severity) / sum(total_housing_units) AS national FROM panel JOIN census USING (fips, year) WHERE storm_severity IS NOT NULL AND total_housing_units > 0 GROUP BY year",
        "national",
    ),
)
def weighted_mean(spark, d):
    joined = T.panel(spark, d).join(T.census(spark, d), ["fips", "year"])
    return rounded(rollups.weighted_mean(joined, ["year"], "storm_severity", "total_housing_units"), "national")


# --- correlations by other methods ----------------------------------------------------

_RANK = "rank() OVER (PARTITION BY a, b ORDER BY {c}) + (count(*) OVER (PARTITION BY a, b, {c}) - 1) / 2.0"
PAIR_ROWS_SQL = """pair_rows AS (SELECT x.component AS a, y.component AS b, x.fips, x.value AS x, y.value AS y FROM centered x JOIN reg rx ON rx.component = x.component
    JOIN centered y ON y.fips = x.fips JOIN reg ry ON ry.component = y.component WHERE rx.pos < ry.pos)"""
SPEARMAN_SQL = f"""spear AS (SELECT a, b, corr(rx, ry) AS r, count(*) AS n FROM (SELECT a, b, {_RANK.format(c='x')} AS rx, {_RANK.format(c='y')} AS ry FROM pair_rows) GROUP BY ALL)"""
DCOR_SQL = """complete AS (SELECT fips FROM centered GROUP BY fips HAVING count(*) = 12),
    cells AS (SELECT * FROM pair_rows SEMI JOIN complete USING (fips)),
    dist AS (SELECT p.a, p.b, p.fips AS i, abs(p.x - q.x) AS u, abs(p.y - q.y) AS v FROM cells p JOIN cells q ON q.a = p.a AND q.b = p.b),
    dmean AS (SELECT a, b, i, avg(u) AS mu, avg(v) AS mv FROM dist GROUP BY ALL),
    dsum AS (SELECT a, b, avg(u * v) AS uv, avg(u * u) AS uu, avg(v * v) AS vv FROM dist GROUP BY ALL),
    dprod AS (SELECT a, b, avg(mu) AS gu, avg(mv) AS gv, avg(mu * mv) AS m_uv, avg(mu * mu) AS m_uu, avg(mv * mv) AS m_vv FROM dmean GROUP BY ALL),
    dcor AS (SELECT a, b, sqrt(greatest(uv + gu * gv - 2 * m_uv, 0) / sqrt((uu + gu * gu - 2 * m_uu) * (vv + gv * gv - 2 * m_vv))) AS r FROM dsum JOIN dprod USING (a, b))"""
_REGION = "CASE substr(fips, 1, 2) " + " ".join(
    f"WHEN '{s}' THEN {n}" for s, n in P.REGION_OF_STATE.items()
) + " END"
PARTIAL_SQL = f"""regional AS (SELECT *, {_REGION} AS region FROM centered WHERE {_REGION} IS NOT NULL),
    resid AS (SELECT fips, component, CASE WHEN region = (SELECT min(region) FROM regional) THEN value ELSE value - avg(value) OVER (PARTITION BY component, region) END AS value FROM regional),
    partial AS (SELECT x.component AS a, y.component AS b, corr(x.value, y.value) AS r, count(*) AS n FROM resid x JOIN reg rx ON rx.component = x.component
        JOIN resid y ON y.fips = x.fips JOIN reg ry ON ry.component = y.component WHERE rx.pos < ry.pos GROUP BY ALL)"""


def pair_table(spark, d, complete: bool = False):
    wide = I.to_wide(centered(spark, d), T.COMPONENTS)
    wide = wide.dropna(subset=T.COMPONENTS) if complete else wide
    return stats.pair_rows(wide, ["scenario"], T.COMPONENTS)


@query("spearman_matrix", steps("centered") + ",\n" + PAIR_ROWS_SQL + ",\n" + SPEARMAN_SQL + rounded_sql("SELECT * FROM spear", "r"))
def spearman_matrix(spark, d):
    return rounded(plain(stats.spearman(pair_table(spark, d), ["scenario", "a", "b"])), "r")


@query("distance_correlation", steps("centered") + ",\n" + PAIR_ROWS_SQL + ",\n" + DCOR_SQL + rounded_sql("SELECT a, b, r FROM dcor", "r"))
def distance_correlation(spark, d):
    return rounded(plain(stats.distance_correlation(pair_table(spark, d, True), ["scenario", "a", "b"])), "r")


@query("partial_correlation", steps("centered") + ",\n" + PARTIAL_SQL + rounded_sql("SELECT a, b, r, n FROM partial", "r"))
def partial_correlation(spark, d):
    long = centered(spark, d).withColumn("region", P.lookup(P.REGION_OF_STATE, C.state_of(F.col("fips"))))
    return rounded(plain(stats.partial_pairs(long, ["scenario"], "fips", "region", T.COMPONENTS)), "r")


_METHODS_SQL = """methods AS (SELECT a, b, 'pearson' AS method, r FROM pairs UNION ALL SELECT a, b, 'spearman', r FROM spear
    UNION ALL SELECT a, b, 'distance', r FROM dcor UNION ALL SELECT a, b, 'partial', r FROM partial)"""
_ROBUST = steps("pairs") + ",\n" + ",\n".join([PAIR_ROWS_SQL, SPEARMAN_SQL, DCOR_SQL, PARTIAL_SQL, _METHODS_SQL])


@query("correlation_robustness", _ROBUST + rounded_sql("SELECT a, b, method, r, round(abs(r), 12) > 0.6 AS flagged FROM methods WHERE r IS NOT NULL", "r"))
def correlation_robustness(spark, d):
    stored = materialize(centered(spark, d), "centered")
    return rounded(plain(I.correlation_robustness(stored, T.COMPONENTS, 0.6)), "r")


@query(
    "correlation_discrepancies",
    _ROBUST + """
    SELECT a, b, count(*) AS n_methods, count(*) FILTER (WHERE round(abs(r), 12) > 0.15) AS n_flagged, true AS conservative_flag FROM methods
    WHERE r IS NOT NULL GROUP BY ALL HAVING n_methods >= 2 AND n_flagged > 0 AND n_flagged < n_methods""",
)
def correlation_discrepancies(spark, d):
    stored = materialize(centered(spark, d), "centered")
    methods = I.correlation_robustness(stored, T.COMPONENTS, 0.15)
    return plain(I.correlation_discrepancies(methods)).drop("methods")


@query(
    "kendall_tau_b",
    T.with_roles("panel") + rounded_sql(
        """SELECT p.year, sum(sign(p.storm_severity - q.storm_severity) * sign(p.extreme_heat_days - q.extreme_heat_days)) /
        sqrt(sum(abs(sign(p.storm_severity - q.storm_severity))) * sum(abs(sign(p.extreme_heat_days - q.extreme_heat_days)))) AS tau
        FROM panel p JOIN panel q ON q.year = p.year GROUP BY p.year""",
        "tau",
    ),
)
def kendall(spark, d):
    return rounded(stats.kendall_tau_b(T.panel(spark, d), ["year"], "storm_severity", "extreme_heat_days"), "tau")


@query(
    "min_rank",
    T.with_roles("panel") + "\nSELECT fips, year, rank() OVER (PARTITION BY year ORDER BY extreme_heat_days) AS position FROM panel",
)
def min_rank(spark, d):
    return with_rank(T.panel(spark, d), ["year"], "extreme_heat_days", "position", "min").select("fips", "year", "position")


@query(
    "rank_descending_average",
    T.with_roles("panel") + rounded_sql(
        "SELECT fips, year, rank() OVER (PARTITION BY year ORDER BY aqi_unhealthy_days DESC) + (count(*) OVER (PARTITION BY year, aqi_unhealthy_days) - 1) / 2.0 AS position FROM panel",
        "position",
    ),
)
def rank_descending(spark, d):
    ranked = with_rank(T.panel(spark, d), ["year"], "aqi_unhealthy_days", "position", "descending")
    return rounded(ranked.select("fips", "year", "position"), "position")


@query(
    "exact_quantiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
    round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY l_returnflag""",
)
def exact_quantiles(spark, d):
    rows = T.table(spark, d, "lineitem")
    return rounded(
        quantiles(rows, ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q99": 0.99}), "q25 q50 q99"
    )


@query(
    "zscore_normalize",
    steps("wins") + rounded_sql(
        "SELECT fips, component, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM wins SEMI JOIN universe USING (fips) WINDOW w AS (PARTITION BY component)",
        "value",
    ),
)
def zscore(spark, d):
    long = I.winsorized_universe(current(spark, d), T.SETTINGS)
    return rounded(plain(windows.zscore_normalize(long, ["scenario", "component"])), "value")


@query(
    "top_k",
    T.with_roles("panel") + "\nSELECT fips, year, storm_severity FROM panel ORDER BY storm_severity DESC, fips, year LIMIT 10",
)
def top_k(spark, d):
    order = [F.col("storm_severity").desc(), F.col("fips"), F.col("year")]
    return windows.top_k(T.panel(spark, d).select("fips", "year", "storm_severity"), order, 10)
