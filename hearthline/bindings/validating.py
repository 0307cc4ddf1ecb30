"""Validation of the scores on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.bindings import tables as T
from hearthline.bindings.registry import pvalue_sql, query, rounded, rounded_sql
from hearthline.bindings.scoring import YEAR, steps
from hearthline.functions import columns as C
from hearthline.operators import rollups, windows
from hearthline.plans import index as I
from hearthline.plans import validation as V
from hearthline.sources import readers as R


def scored(spark, d):
    return I.compute_index(T.panel(spark, d), T.SETTINGS).scores.select("fips", "index_score")


def multi_year(spark, d):
    """Scores of every year: a component stands in for the index of the year."""
    panel = T.panel(spark, d)
    return panel.withColumn("index_score", F.col("flood_exposure") / 40.0 + F.col("storm_severity"))


MULTI_SQL = "multi AS (SELECT *, flood_exposure / 40.0 + storm_severity AS index_score FROM panel)"
PAIRED_SQL = """yp AS (SELECT year, lead(year) OVER (ORDER BY year) AS nxt FROM (SELECT DISTINCT year FROM multi)),
    paired AS (SELECT concat(a.year, '-', b.year) AS year_pair, a.fips, a.index_score AS x, b.index_score AS y FROM multi a JOIN yp ON yp.year = a.year JOIN multi b ON b.year = yp.nxt AND b.fips = a.fips),
    persist AS (SELECT year_pair, corr(rx, ry) AS r, count(*) AS n FROM (SELECT year_pair, rank() OVER (PARTITION BY year_pair ORDER BY x) + (count(*) OVER (PARTITION BY year_pair, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY year_pair ORDER BY y) + (count(*) OVER (PARTITION BY year_pair, y) - 1) / 2.0 AS ry FROM paired) GROUP BY year_pair)"""
_MULTI = T.with_roles("panel") + ", " + MULTI_SQL + ", " + PAIRED_SQL


@query(
    "rank_persistence",
    _MULTI + rounded_sql(
        """SELECT year_pair, r AS spearman_r, tanh(atanh(r) - 1.96 / sqrt(n - 3)) AS ci_low, tanh(atanh(r) + 1.96 / sqrt(n - 3)) AS ci_high, r > 0.9 AS passes, n FROM persist""",
        "spearman_r ci_low ci_high",
    ),
)
def rank_persistence(spark, d):
    return rounded(V.rank_persistence(multi_year(spark, d)), "spearman_r ci_low ci_high")


@query(
    "fisher_ci",
    T.with_roles("panel") + rounded_sql(
        """SELECT year, r, tanh(atanh(r) - 1.96 / sqrt(n - 3)) AS ci_low, tanh(atanh(r) + 1.96 / sqrt(n - 3)) AS ci_high
        FROM (SELECT year, corr(flood_exposure, storm_severity) AS r, count(*) AS n FROM panel GROUP BY year)""",
        "r ci_low ci_high",
    ),
)
def fisher_ci(spark, d):
    from hearthline.operators.stats import pearson

    both = T.panel(spark, d).groupBy("year").agg(
        pearson("flood_exposure", "storm_severity").alias("r"), F.count(F.lit(1)).alias("n")
    )
    result = both.select(
        "year", "r", C.fisher_bound(F.col("r"), F.col("n"), -1).alias("ci_low"), C.fisher_bound(F.col("r"), F.col("n"), 1).alias("ci_high")
    )
    return rounded(result, "r ci_low ci_high")


TURNOVER_SQL = """cuts AS (SELECT year_pair, quantile_cont(x, 0.9) AS xh, quantile_cont(y, 0.9) AS yh, quantile_cont(x, 0.1) AS xl, quantile_cont(y, 0.1) AS yl, count(*) AS n FROM paired GROUP BY year_pair),
    turnover AS (SELECT year_pair, 'top' AS decile, count(*) FILTER (WHERE x >= xh AND NOT y >= yh) * 100.0 / count(*) FILTER (WHERE x >= xh) AS turnover_pct FROM paired JOIN cuts USING (year_pair) WHERE n >= 10 GROUP BY ALL
    UNION ALL SELECT year_pair, 'bottom', count(*) FILTER (WHERE x <= xl AND NOT y <= yl) * 100.0 / count(*) FILTER (WHERE x <= xl) FROM paired JOIN cuts USING (year_pair) WHERE n >= 10 GROUP BY ALL)"""


@query(
    "decile_turnover",
    _MULTI + ", " + TURNOVER_SQL + rounded_sql(
        "SELECT year_pair, decile, turnover_pct, 20.0::DOUBLE AS threshold, turnover_pct < 20 AS passes FROM turnover", "turnover_pct"
    ),
)
def decile_turnover(spark, d):
    return rounded(V.decile_turnover(multi_year(spark, d)), "turnover_pct")


BANDS_SQL = """banded AS (SELECT fips, CAST(floor(index_score / 10) * 10 AS INTEGER) AS band, count(*) AS n FROM multi
    WHERE year IN (SELECT DISTINCT year FROM multi ORDER BY year DESC LIMIT 5) GROUP BY ALL),
    bands AS (SELECT fips, arg_max(band, n * 100000 - band) AS modal_band, max(n) AS years_in_modal_band,
        CASE WHEN max(n) >= 4 THEN 'high_stability' WHEN count(*) >= 3 THEN 'low_stability' ELSE 'moderate_stability' END AS stability_class FROM banded GROUP BY fips)"""


@query("score_bands", _MULTI + ", " + BANDS_SQL + "\nSELECT * FROM bands")
def score_bands(spark, d):
    return windows.score_bands(multi_year(spark, d), "index_score")


@query(
    "modal_value",
    """SELECT l_suppkey, l_quantity AS modal_quantity, n FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity)
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1""",
)
def modal_value(spark, d):
    counts = T.table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("l_suppkey").agg(
        F.max_by("l_quantity", F.struct(F.col("n"), -F.col("l_quantity"))).alias("modal_quantity"), F.max("n").alias("n")
    )


# Drivers and component ranks over four of the components, largest absolute value first.
_FOUR = ["hdd_anomaly", "cdd_anomaly", "pm25_annual", "drought_score"]
_DRIVER_SQL = "CASE greatest(" + ", ".join(f"abs({c})" for c in _FOUR) + ") " + " ".join(
    f"WHEN abs({c}) THEN '{c}'" for c in _FOUR
) + " END"


@query(
    "argmax_driver",
    T.with_roles("panel") + f"\nSELECT fips, year, {_DRIVER_SQL} AS driver FROM panel",
)
def argmax_driver(spark, d):
    panel = T.panel(spark, d)
    return panel.select("fips", "year", windows.argmax_driver(panel, _FOUR).alias("driver"))


CONTRIB_SQL = f"""sized AS (SELECT fips, year, u.component, abs(u.value) AS v FROM panel, LATERAL (VALUES {", ".join(f"('{c}', {c})" for c in _FOUR)}) u(component, value)),
    sized_rank AS (SELECT fips, year, component, rank() OVER (PARTITION BY fips, year ORDER BY v DESC) + (count(*) OVER (PARTITION BY fips, year, v) - 1) / 2.0 AS r FROM sized WHERE v IS NOT NULL),
    drivers AS (SELECT fips, year, {_DRIVER_SQL} AS driver FROM panel),
    contrib AS (SELECT a.fips, concat(yp.year, '-', yp.nxt) AS year_pair, (SELECT corr(p.r, q.r) FROM sized_rank p JOIN sized_rank q ON q.fips = p.fips AND q.component = p.component AND q.year = yp.nxt WHERE p.fips = a.fips AND p.year = yp.year) AS r,
        a.driver AS d1, b.driver AS d2 FROM drivers a JOIN yp ON yp.year = a.year JOIN drivers b ON b.fips = a.fips AND b.year = yp.nxt)"""


@query(
    "contribution_stability",
    _MULTI + ", " + CONTRIB_SQL + rounded_sql(
        "SELECT fips, year_pair, r AS component_rank_spearman_r, d1 AS primary_driver_year1, d2 AS primary_driver_year2, d1 <> d2 AS driver_changed FROM contrib",
        "component_rank_spearman_r",
    ),
)
def contribution_stability(spark, d):
    return rounded(V.contribution_stability(T.panel(spark, d), _FOUR), "component_rank_spearman_r")


@query(
    "stability_report",
    _MULTI + ", " + ", ".join([TURNOVER_SQL, BANDS_SQL, CONTRIB_SQL]) + rounded_sql(
        """SELECT 'rank_persistence' AS metric, year_pair, r AS value, 0.9::DOUBLE AS threshold, r > 0.9 AS passes, 'success' AS status FROM persist
        UNION ALL SELECT concat('decile_turnover_', decile), year_pair, turnover_pct, 20.0, turnover_pct < 20, 'success' FROM turnover
        UNION ALL SELECT 'score_band_stability', 'trailing_5yr', count(*) FILTER (WHERE stability_class = 'high_stability') * 100.0 / count(*), NULL, NULL, 'success' FROM bands
        UNION ALL SELECT 'component_contribution_stability', 'all', avg(r), NULL, NULL, 'success' FROM contrib""",
        "value",
    ),
)
def stability_report(spark, d):
    table = multi_year(spark, d).select("fips", "year", "index_score", *_FOUR)
    return rounded(V.stability_report(table).drop("note"), "value")


# --- external and convergent -------------------------------------------------------------

VOL_SQL = f"""vol_years AS (SELECT fips, year, energy_cost_attributed AS v FROM panel WHERE year BETWEEN {YEAR} - 5 AND {YEAR} AND energy_cost_attributed IS NOT NULL),
    vol_next AS (SELECT year, lead(year) OVER (ORDER BY year) AS nxt FROM (SELECT DISTINCT year FROM vol_years)),
    vol AS (SELECT a.fips, stddev_samp(b.v - a.v) AS volatility FROM vol_years a JOIN vol_next USING (year) JOIN vol_years b ON b.fips = a.fips AND b.year = nxt GROUP BY a.fips HAVING count(*) > 1)"""


@query("volatility", T.with_roles("panel") + ", " + VOL_SQL + rounded_sql("SELECT * FROM vol", "volatility"))
def volatility(spark, d):
    return rounded(rollups.volatility(T.panel(spark, d), "energy_cost_attributed", YEAR), "volatility")


GROWTH_SQL = """growth AS (SELECT a.fips, (b.population - a.population) / a.population AS growth FROM census a JOIN census b USING (fips)
    WHERE a.year = (SELECT max(year) FROM census WHERE year < (SELECT max(year) FROM census)) AND b.year = (SELECT max(year) FROM census) AND a.population <> 0)"""


@query("growth_rate", T.with_roles("census") + ", " + GROWTH_SQL + rounded_sql("SELECT * FROM growth", "growth"))
def growth_rate(spark, d):
    return rounded(rollups.growth_rate(T.census(spark, d), "population"), "growth")


_TEST_SQL = """SELECT year, corr(storm_severity, health_burden) AS pearson_r, corr(rx, ry) AS spearman_r, count(*) AS n_observations FROM (
        SELECT year, storm_severity, health_burden, rank() OVER (PARTITION BY year ORDER BY storm_severity) + (count(*) OVER (PARTITION BY year, storm_severity) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY year ORDER BY health_burden) + (count(*) OVER (PARTITION BY year, health_burden) - 1) / 2.0 AS ry FROM panel WHERE health_burden IS NOT NULL AND storm_severity IS NOT NULL) GROUP BY year"""
_P_COLUMNS = "pearson_r spearman_r p_value_pearson p_value_spearman"


def _with_pvalues(body: str, n: str) -> str:
    return f"SELECT *, {pvalue_sql('pearson_r', n)} AS p_value_pearson, {pvalue_sql('spearman_r', n)} AS p_value_spearman FROM ({body})"


@query("pearson_spearman_test", T.with_roles("panel") + rounded_sql(_with_pvalues(_TEST_SQL, "n_observations"), _P_COLUMNS))
def pearson_spearman_test(spark, d):
    result = V.correlation_test(T.panel(spark, d), ["year"], "storm_severity", "health_burden")
    return rounded(result, _P_COLUMNS)


@query(
    "correlation_pvalues",
    T.with_roles("panel") + rounded_sql(
        "SELECT year, p_value_pearson, p_value_spearman FROM (" + _with_pvalues(_TEST_SQL, "n_observations") + ")", "p_value_pearson:9 p_value_spearman:9"
    ),
)
def correlation_pvalues(spark, d):
    """The p-values alone, compared at nine decimals."""
    result = V.correlation_test(T.panel(spark, d), ["year"], "storm_severity", "health_burden")
    return rounded(result.select("year", "p_value_pearson", "p_value_spearman"), "p_value_pearson:9 p_value_spearman:9")


_AVG_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


def _pair_sql(source: str, value: str) -> str:
    return f"""SELECT corr(x, y) AS pearson_r, corr(rx, ry) AS spearman_r, count(*) AS n FROM (SELECT x, y, {_AVG_RANK.format(c='x')} AS rx, {_AVG_RANK.format(c='y')} AS ry
        FROM (SELECT index_score AS x, {value} AS y FROM scores JOIN {source} USING (fips) WHERE {value} IS NOT NULL))"""


EXTERNAL_SQL = f"""ext AS (SELECT 'fema_ia_per_household' AS indicator, * FROM ({_pair_sql(f'(SELECT fips, fema_ia_burden FROM panel WHERE year = {YEAR})', 'fema_ia_burden')})
    UNION ALL SELECT 'energy_bill_volatility', * FROM ({_pair_sql('vol', 'volatility')})
    UNION ALL SELECT 'net_domestic_migration', * FROM ({_pair_sql('growth', 'growth')})),
    expected(indicator, geographic_level, lo, hi, signed) AS (VALUES """ + ", ".join(
    f"('{n}', '{level}', {lo}::DOUBLE, {hi}::DOUBLE, {str(signed).lower()})" for n, level, lo, hi, signed, _ in V.INDICATORS
) + """),
    external AS (SELECT indicator, geographic_level, pearson_r, spearman_r, n AS n_observations, lo AS expected_r_low, hi AS expected_r_high,
        CASE WHEN signed THEN pearson_r ELSE abs(pearson_r) END BETWEEN lo AND hi AS within_expected, CASE WHEN n IS NULL THEN 'data_unavailable' ELSE 'success' END AS status FROM expected LEFT JOIN ext USING (indicator))"""
_EXTERNAL = steps("scores", "census") + ", " + ", ".join([VOL_SQL, GROWTH_SQL, EXTERNAL_SQL])


@query("external_criteria", _EXTERNAL + rounded_sql(_with_pvalues("SELECT * FROM external", "n_observations"), _P_COLUMNS))
def external_criteria(spark, d):
    result = V.external_validation(scored(spark, d), T.panel(spark, d), T.census(spark, d), YEAR)
    return rounded(result.drop("note"), _P_COLUMNS)


def benchmark(spark, d):
    """A risk table under foreign column names, from the suppliers' balances."""
    raw = T.table(spark, d, "supplier").select(
        T.county(F.col("s_nationkey"), F.col("s_suppkey")).alias("STCOFIPS"), F.col("s_acctbal").cast("string").alias("RISK_SCORE")
    )
    return R.risk_benchmark(raw)


CONVERGENT_SQL = f"""bench AS (SELECT printf('%02d%03d', s_nationkey + 1, s_suppkey) AS fips, s_acctbal AS nri_score FROM supplier),
    conv AS ({_pair_sql('bench', 'nri_score')}),
    targets(benchmark, validity_type, lo, hi) AS (VALUES ('fema_nri', 'convergent', 0.4::DOUBLE, 0.7::DOUBLE), ('fema_nri', 'divergent', 0.0, 0.85), ('first_street', 'convergent', 0.4, 0.7), ('first_street', 'divergent', 0.0, 0.85)),
    convergent AS (SELECT benchmark, validity_type, pearson_r, spearman_r, n AS n_observations, lo AS target_r_low, hi AS target_r_high,
        CASE WHEN validity_type = 'convergent' THEN abs(pearson_r) BETWEEN lo AND hi ELSE abs(pearson_r) < hi END AS within_target,
        CASE WHEN pearson_r IS NULL THEN 'data_unavailable' ELSE 'success' END AS status FROM targets LEFT JOIN conv ON benchmark = 'fema_nri')"""


@query("convergent_divergent", steps("scores") + ", " + CONVERGENT_SQL + rounded_sql(_with_pvalues("SELECT * FROM convergent", "n_observations"), _P_COLUMNS))
def convergent_divergent(spark, d):
    result = V.convergent_divergent(scored(spark, d), benchmark(spark, d)).drop("interpretation")
    return rounded(result, _P_COLUMNS)


@query(
    "interpret_correlation",
    T.with_roles("panel") + """, r AS (SELECT fips, abs(corr(flood_exposure, storm_severity)) AS s, count(*) AS n FROM panel GROUP BY fips)
    SELECT fips, CASE WHEN s < 0.3 THEN 'WARNING: index may not capture hazard exposure' WHEN s < 0.4 THEN 'Below convergent target but shows meaningful correlation'
    WHEN s <= 0.7 THEN 'Within convergent target range' WHEN s < 0.85 THEN 'Above convergent target, higher overlap than expected' WHEN s IS NOT NULL THEN 'WARNING: index may be duplicating existing metric' END AS interpretation FROM r""",
)
def interpret_correlation(spark, d):
    from hearthline.operators.stats import pearson

    both = T.panel(spark, d).groupBy("fips").agg(pearson("flood_exposure", "storm_severity").alias("r"))
    return both.select("fips", C.interpret_correlation(F.col("r")).alias("interpretation"))


@query(
    "validation_report",
    _EXTERNAL + ", " + CONVERGENT_SQL + rounded_sql(
        """SELECT 'external_criteria' AS test_category, indicator AS test_name, pearson_r AS result, within_expected AS passes, status FROM external
        UNION ALL SELECT 'convergent_divergent', concat_ws('_', benchmark, validity_type), pearson_r, within_target, status FROM convergent
        UNION ALL SELECT 'stability', 'all', NULL, NULL, 'no_multi_year_data'""",
        "result",
    ),
)
def validation_report(spark, d):
    scores = scored(spark, d)
    report = V.validation_report(
        V.external_validation(scores, T.panel(spark, d), T.census(spark, d), YEAR),
        V.convergent_divergent(scores, benchmark(spark, d)), None,
    )
    # Both sides of the report say "not available" for a missing stability input.
    return rounded(report.drop("threshold"), "result")


@query(
    "report_counts",
    _EXTERNAL + """
    SELECT count(*) FILTER (WHERE within_expected) AS n_passed, count(*) FILTER (WHERE NOT within_expected AND status = 'success') AS n_failed,
    count(*) FILTER (WHERE status = 'data_unavailable') AS n_skipped, count(*) FILTER (WHERE status = 'failed') AS n_errored FROM external""",
)
def report_counts(spark, d):
    external = V.external_validation(scored(spark, d), T.panel(spark, d), T.census(spark, d), YEAR)
    return V.report_counts(external.select(F.col("within_expected").alias("passes"), "status"))


