"""Sensitivity analysis on the bound panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.bindings import tables as T
from hearthline.bindings.registry import QUERIES, pvalue_sql, query, rounded, rounded_sql
from hearthline.bindings.scoring import REG_SQL, YEAR, current, ready, steps
from hearthline.operators import windows
from hearthline.operators.joins import year_pairs
from hearthline.plans import index as I
from hearthline.plans import scenarios as S

#: All draws of the method.
ITERATIONS = T.SETTINGS.monte_carlo_iterations

# Composite and comparison for a table ``alt_parts(scenario, fips, score)``.
_ALT_SQL = """alt_raw AS (SELECT scenario, fips, sum(score) AS raw FROM alt_parts GROUP BY ALL),
    alt_k AS (SELECT scenario, 40 / (quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25)) AS k FROM alt_raw GROUP BY scenario),
    alt AS (SELECT scenario, fips, 100 + k * raw AS index_score FROM alt_raw JOIN alt_k USING (scenario))"""
_COMPARE_SQL = """shared AS (SELECT a.scenario, a.fips, s.index_score AS x, a.index_score AS y FROM alt a JOIN scores s USING (fips)),
    ranked AS (SELECT scenario, fips, rank() OVER (PARTITION BY scenario ORDER BY x) AS primary_rank, rank() OVER (PARTITION BY scenario ORDER BY y) AS alt_rank FROM shared),
    agree AS (SELECT scenario, corr(primary_rank, alt_rank) AS spearman_r, max(abs(alt_rank - primary_rank)) AS max_rank_shift,
        count(*) FILTER (WHERE abs(alt_rank - primary_rank) > 10) AS n_shifted_gt_10, count(*) FILTER (WHERE abs(alt_rank - primary_rank) > 15) AS n_shifted_gt_15 FROM ranked GROUP BY scenario)"""


def _schemes_sql(schemes: dict[str, dict[str, float]]) -> str:
    rows = ", ".join(f"('{s}', '{c}', {w!r}::DOUBLE)" for s, v in schemes.items() for c, w in v.items())
    return f"schemes(scenario, component, w) AS (VALUES {rows})"


def chain(*parts: str) -> str:
    return ",\n" + ",\n".join(parts)


_JACK_PARTS = "alt_parts AS (SELECT scenario, fips, value * w AS score FROM parts JOIN schemes USING (component))"
JACK_SQL = chain(_schemes_sql(S.jackknife_schemes(P.base_weights())), _JACK_PARTS, _ALT_SQL, _COMPARE_SQL)


@query(
    "jackknife",
    steps("scores") + JACK_SQL + rounded_sql(
        "SELECT scenario AS excluded_component, spearman_r, max_rank_shift, n_shifted_gt_10 FROM agree", "spearman_r"
    ),
)
def jackknife(spark, d):
    return rounded(S.jackknife(ready(spark, d), T.SETTINGS).drop("most_affected_counties"), "spearman_r")


@query(
    "top_rank_shifts",
    steps("scores") + JACK_SQL + """
    SELECT scenario AS excluded_component, fips, primary_rank, alt_rank, abs(alt_rank - primary_rank) AS shift
    FROM ranked QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY abs(alt_rank - primary_rank) DESC, fips) <= 10""",
)
def top_rank_shifts(spark, d):
    table = S.jackknife(ready(spark, d), T.SETTINGS)
    return table.select("excluded_component", F.inline("most_affected_counties"))


_EQUAL = {c: 1.0 / len(P.REGISTRY) for c in P.COMPONENT_IDS}
_NEUTRAL_PARTS = """neutral_parts AS (SELECT fips, component, value * coalesce(penalty, 1) AS value FROM centered LEFT JOIN penalties USING (component))"""


@query(
    "alt_weighting",
    steps("scores") + chain(
        _schemes_sql({"equal": _EQUAL, "pure_risk": P.RISK_WEIGHTS, "pure_budget": P.base_weights(), "neutral_acceleration": P.base_weights()}),
        _NEUTRAL_PARTS,
        """alt_parts AS (SELECT scenario, fips, value * w AS score FROM parts JOIN schemes USING (component) WHERE scenario IN ('equal', 'pure_risk')
        UNION ALL SELECT scenario, fips, value * w FROM neutral_parts JOIN schemes USING (component) WHERE scenario NOT IN ('equal', 'pure_risk'))""",
        _ALT_SQL, _COMPARE_SQL,
    ) + rounded_sql(
        """SELECT scenario AS scheme, spearman_r AS spearman_r_vs_primary, max_rank_shift, n_shifted_gt_10, q2 AS median_index_score, q1 AS iqr_low, q3 AS iqr_high FROM agree
        JOIN (SELECT scenario, quantile_cont(index_score, 0.25) AS q1, median(index_score) AS q2, quantile_cont(index_score, 0.75) AS q3 FROM alt GROUP BY scenario) USING (scenario)""",
        "spearman_r_vs_primary median_index_score iqr_low iqr_high",
    ),
)
def alt_weighting(spark, d):
    return rounded(
        S.alternative_weightings(ready(spark, d), T.SETTINGS), "spearman_r_vs_primary median_index_score iqr_low iqr_high"
    )


_SWEEP = (0.1, 0.2, 0.6)


def _sweep_sql(thresholds) -> str:
    return (
        steps("scores") + chain(
            "sweep(threshold) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in thresholds) + ")",
            """sweep_pen AS (SELECT threshold, loser AS component, greatest(0.2, product(1 - r * r)) AS penalty FROM (
                SELECT threshold, CASE WHEN ra.place <= rb.place THEN b ELSE a END AS loser, r FROM pairs JOIN reg ra ON ra.component = a JOIN reg rb ON rb.component = b JOIN sweep ON round(abs(r), 12) > threshold) GROUP BY ALL)""",
            """alt_parts AS (SELECT CAST(s.threshold AS VARCHAR) AS scenario, c.fips, c.value * coalesce(p.penalty, 1) * coalesce(acceleration, 1) * weight AS score
                FROM centered c CROSS JOIN sweep s JOIN reg USING (component) LEFT JOIN sweep_pen p ON p.component = c.component AND p.threshold = s.threshold LEFT JOIN accel a ON a.fips = c.fips AND a.component = c.component)""",
            _ALT_SQL, _COMPARE_SQL,
        ) + rounded_sql(
            """SELECT CAST(scenario AS DOUBLE) AS threshold, coalesce(n, 0) AS n_penalized, spearman_r AS spearman_r_vs_primary, max_rank_shift, n_shifted_gt_10
            FROM agree LEFT JOIN (SELECT CAST(threshold AS VARCHAR) AS scenario, count(*) FILTER (WHERE penalty < 1) AS n FROM sweep_pen GROUP BY ALL) USING (scenario)""",
            "spearman_r_vs_primary",
        )
    )


@query("threshold_sweep", _sweep_sql(_SWEEP))
def threshold_sweep(spark, d):
    result = S.threshold_sweep(ready(spark, d), T.SETTINGS, _SWEEP).drop("penalties")
    return rounded(result, "spearman_r_vs_primary")


_TAU = """tau AS (SELECT p.scenario, sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))) AS kendall_tau
    FROM shared p JOIN shared q ON q.scenario = p.scenario GROUP BY p.scenario)"""
_Z_PARTS = """zed AS (SELECT fips, component, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM wins SEMI JOIN universe USING (fips) WINDOW w AS (PARTITION BY component)),
    alt_parts AS (SELECT 'z_score' AS scenario, fips, value * coalesce(penalty, 1) * coalesce(acceleration, 1) * weight AS score FROM zed JOIN reg USING (component) LEFT JOIN penalties USING (component) LEFT JOIN accel USING (fips, component)
    UNION ALL SELECT 'percentile', fips, score FROM comp_scores)"""


@query(
    "normalization_compare",
    steps("scores") + chain(_Z_PARTS, _ALT_SQL, _COMPARE_SQL, _TAU) + rounded_sql(
        "SELECT scenario AS normalization, spearman_r AS spearman_r_vs_primary, kendall_tau, max_rank_shift, n_shifted_gt_10 FROM agree JOIN tau USING (scenario)",
        "spearman_r_vs_primary kendall_tau",
    ),
)
def normalization_compare(spark, d):
    return rounded(S.normalization_compare(ready(spark, d), T.SETTINGS), "spearman_r_vs_primary kendall_tau")


@query(
    "compare_rankings",
    steps("scores") + chain(_Z_PARTS, _ALT_SQL, _COMPARE_SQL, _TAU) + rounded_sql(
        "SELECT scenario, spearman_r, " + pvalue_sql("spearman_r", "n_shared") + """ AS spearman_p, max_rank_shift, n_shifted_gt_10, n_shifted_gt_15, kendall_tau, n_shared
        FROM agree JOIN tau USING (scenario) JOIN (SELECT scenario, count(*) AS n_shared FROM shared GROUP BY scenario) USING (scenario)""",
        "spearman_r spearman_p kendall_tau",
    ),
)
def compare_rankings(spark, d):
    """The z-score index and the primary one itself against the primary index, ranked over the counties they share."""
    base = S.share(ready(spark, d), T.SETTINGS)
    scaled = windows.zscore_normalize(I.winsorized_universe(current(spark, d), T.SETTINGS), ["scenario", "component"])
    parts = I.contributions(scaled, base.ready.penalties, base.ready.accelerations)
    other = I.composite(I.component_scores(parts, S.base_weights_frame(spark)), T.SETTINGS)[0]
    both = other.select(F.lit("z_score").alias("scenario"), "fips", "index_score").unionByName(
        base.primary.select(F.lit("percentile").alias("scenario"), "fips", "index_score")
    )
    compared = S.compare_rankings(base.primary.select("fips", "index_score"), both).drop("top_shifted")
    return rounded(compared, "spearman_r spearman_p kendall_tau")


_WINDOWS = (3, 5, 7, 10)


def _window_sql(lengths) -> str:
    spans = ", ".join(
        f"('{w}', '{c.id}', {c.window if c.id in P.STATIC_COMPONENTS else w})" for w in lengths for c in P.REGISTRY
    )
    return chain(
        f"spans(scenario, component, span2) AS (VALUES {spans})",
        f"""wpts AS (SELECT scenario, fips, component, year, value, span2 FROM panel_long JOIN spans USING (component) WHERE year BETWEEN {YEAR} - span2 + 1 AND {YEAR})""",
        """wslopes AS (SELECT scenario, fips, component, CASE WHEN years < 2 THEN 0 WHEN n >= greatest(2, ceil(span2 * 0.8)) THEN slope END AS slope FROM
        (SELECT scenario, fips, component, span2, count(*) AS n FROM wpts GROUP BY ALL) JOIN (SELECT scenario, component, count(DISTINCT year) AS years FROM wpts GROUP BY ALL) USING (scenario, component)
        LEFT JOIN (SELECT p.scenario, p.fips, p.component, median((q.value - p.value) / (q.year - p.year)) AS slope FROM wpts p JOIN wpts q ON q.scenario = p.scenario AND q.fips = p.fips AND q.component = p.component AND q.year > p.year GROUP BY ALL) USING (scenario, fips, component))""",
        """waccel AS (SELECT scenario, fips, component, least(3.0, greatest(0.5, CASE WHEN sigma > 0 THEN coalesce(CASE WHEN abs(med) >= 0.1 * sigma THEN slope / med ELSE 1 + (slope - med) / sigma END, 1) ELSE 1 END)) AS acceleration
        FROM wslopes JOIN (SELECT scenario, component, median(slope) AS med, stddev_samp(slope) AS sigma FROM wslopes GROUP BY ALL) USING (scenario, component))""",
        """alt_parts AS (SELECT w.scenario, c.fips, c.value * coalesce(penalty, 1) * coalesce(acceleration, 1) * weight AS score
        FROM centered c CROSS JOIN (SELECT DISTINCT scenario FROM spans) w JOIN reg USING (component) LEFT JOIN penalties USING (component) LEFT JOIN waccel a ON a.scenario = w.scenario AND a.fips = c.fips AND a.component = c.component)""",
        """wall AS (SELECT w.scenario, coalesce(acceleration, 1) AS acceleration FROM (SELECT DISTINCT scenario, component FROM spans) w CROSS JOIN (SELECT DISTINCT fips FROM panel) u
        LEFT JOIN waccel a ON a.scenario = w.scenario AND a.component = w.component AND a.fips = u.fips)""",
        _ALT_SQL, _COMPARE_SQL,
    )


@query(
    "window_sensitivity",
    steps("scores") + _window_sql(_WINDOWS) + rounded_sql(
        """SELECT CAST(scenario AS INTEGER) AS window_years, spearman_r AS spearman_r_vs_primary, max_rank_shift, m AS median_acceleration, lo AS pct_at_lower_bound, hi AS pct_at_upper_bound FROM agree JOIN (
        SELECT scenario, median(acceleration) AS m, avg(CASE WHEN acceleration = 0.5 THEN 100.0 ELSE 0 END) AS lo, avg(CASE WHEN acceleration = 3 THEN 100.0 ELSE 0 END) AS hi FROM wall GROUP BY scenario) USING (scenario)""",
        "spearman_r_vs_primary median_acceleration pct_at_lower_bound pct_at_upper_bound",
    ),
)
def window_sensitivity(spark, d):
    return rounded(
        S.window_sensitivity(ready(spark, d), T.SETTINGS, _WINDOWS),
        "spearman_r_vs_primary median_acceleration pct_at_lower_bound pct_at_upper_bound",
    )


# --- full recomputations: every step keyed by scenario ---------------------------------


def _full_sql(variants: str) -> str:
    """The index steps over ``variants(scenario, fips, year, component, value)``."""
    over = "PARTITION BY scenario, component"
    return chain(
        variants,
        f"""fuse AS (SELECT scenario, fips FROM variants WHERE year = {YEAR} GROUP BY ALL HAVING count(*) FILTER (WHERE component IN ('hdd_anomaly', 'cdd_anomaly')) > 0
            AND count(*) FILTER (WHERE component IN ('drought_score', 'storm_severity')) = 2)""",
        f"""ftrans AS (SELECT scenario, fips, component, CASE WHEN kind = 'log' AND value >= 0 THEN ln(1 + value) WHEN kind = 'sqrt' THEN sign(value) * sqrt(abs(value)) ELSE value END AS value
            FROM variants JOIN reg USING (component) WHERE year = {YEAR})""",
        """fwins AS (SELECT scenario, fips, component, least(value, cut) AS value FROM ftrans JOIN (SELECT scenario, component, quantile_cont(value, 0.99) AS cut FROM ftrans GROUP BY ALL) USING (scenario, component))""",
        f"""fcent AS (SELECT scenario, fips, component, (rank() OVER ({over} ORDER BY value) + (count(*) OVER ({over}, value) - 1) / 2.0) / count(*) OVER ({over}) * 100.0 - 50.0 AS value FROM fwins SEMI JOIN fuse USING (scenario, fips))""",
        """fpairs AS (SELECT x.scenario, x.component AS a, y.component AS b, corr(x.value, y.value) AS r, rx.place AS pa, ry.place AS pb FROM fcent x JOIN reg rx ON rx.component = x.component
            JOIN fcent y ON y.scenario = x.scenario AND y.fips = x.fips JOIN reg ry ON ry.component = y.component WHERE rx.pos < ry.pos GROUP BY ALL)""",
        """fpen AS (SELECT scenario, CASE WHEN pa <= pb THEN b ELSE a END AS component, greatest(0.2, product(1 - r * r)) AS penalty FROM fpairs WHERE round(abs(r), 12) > 0.6 GROUP BY ALL)""",
        f"""fpts AS (SELECT scenario, fips, component, year, value, span FROM variants JOIN reg USING (component) WHERE year BETWEEN {YEAR} - span + 1 AND {YEAR})""",
        """fslopes AS (SELECT scenario, fips, component, CASE WHEN years < 2 THEN 0 WHEN n >= greatest(2, ceil(span * 0.8)) THEN slope END AS slope FROM
            (SELECT scenario, fips, component, span, count(*) AS n FROM fpts GROUP BY ALL) JOIN (SELECT scenario, component, count(DISTINCT year) AS years FROM fpts GROUP BY ALL) USING (scenario, component)
            LEFT JOIN (SELECT p.scenario, p.fips, p.component, median((q.value - p.value) / (q.year - p.year)) AS slope FROM fpts p JOIN fpts q ON q.scenario = p.scenario AND q.fips = p.fips AND q.component = p.component AND q.year > p.year GROUP BY ALL) USING (scenario, fips, component))""",
        """faccel AS (SELECT scenario, fips, component, least(3.0, greatest(0.5, CASE WHEN sigma > 0 THEN coalesce(CASE WHEN abs(med) >= 0.1 * sigma THEN slope / med ELSE 1 + (slope - med) / sigma END, 1) ELSE 1 END)) AS acceleration
            FROM fslopes JOIN (SELECT scenario, component, median(slope) AS med, stddev_samp(slope) AS sigma FROM fslopes GROUP BY ALL) USING (scenario, component))""",
        """alt_parts AS (SELECT scenario, fips, value * coalesce(penalty, 1) * coalesce(acceleration, 1) * weight AS score FROM fcent JOIN reg USING (component) LEFT JOIN fpen USING (scenario, component) LEFT JOIN faccel USING (scenario, fips, component))""",
        _ALT_SQL,
        _COMPARE_SQL.replace("FROM alt a JOIN scores s USING (fips)", "FROM alt a JOIN alt s ON s.fips = a.fips AND s.scenario = 'primary' WHERE a.scenario <> 'primary'"),
    )


_FACTORS = (0.75, 0.875, 1.0, 1.125, 1.25)
_FACTOR_ROWS = "('primary', 1.0::DOUBLE), " + ", ".join(f"('{f}', {f}::DOUBLE)" for f in _FACTORS)
_FULL_ROLES = T.with_roles("panel_long") + ", " + REG_SQL


@query(
    "severity_perturbation",
    _FULL_ROLES + _full_sql(
        f"""variants AS (SELECT scenario, fips, year, component, CASE WHEN component = 'storm_severity' THEN value * factor ELSE value END AS value
        FROM panel_long, (VALUES {_FACTOR_ROWS}) f(scenario, factor))"""
    ) + rounded_sql(
        "SELECT CAST(scenario AS DOUBLE) AS perturbation_factor, spearman_r AS spearman_r_vs_primary, max_rank_shift, n_shifted_gt_10 FROM agree",
        "spearman_r_vs_primary",
    ),
)
def severity_perturbation(spark, d):
    return rounded(S.severity_perturbation(T.panel(spark, d), T.SETTINGS, _FACTORS), "spearman_r_vs_primary")


@query(
    "baseline_comparison",
    _FULL_ROLES + _full_sql(
        """variants AS (SELECT 'primary' AS scenario, fips, year, component, value FROM panel_long
        UNION ALL SELECT '1981-2010', p.fips, p.year, p.component, CASE WHEN p.component = 'hdd_anomaly' THEN p.value + 0.5 * o.pm25_annual WHEN p.component = 'cdd_anomaly' THEN p.value - 0.5 * o.drought_score ELSE p.value END
        FROM panel_long p JOIN panel o USING (fips, year))"""
    ) + rounded_sql(
        """SELECT scenario AS baseline, spearman_r AS spearman_r_vs_primary, CAST(max_rank_shift AS BIGINT) AS max_rank_shift, n_shifted_gt_10, 'computed' AS status FROM agree
        UNION ALL SELECT '1991-2020', 1.0, 0, 0, 'primary'""",
        "spearman_r_vs_primary",
    ),
)
def baseline_comparison(spark, d):
    panel = T.panel(spark, d)
    other = panel.select(
        "fips", "year", (F.col("hdd_anomaly") + 0.5 * F.col("pm25_annual")).alias("hdd_anomaly"),
        (F.col("cdd_anomaly") - 0.5 * F.col("drought_score")).alias("cdd_anomaly"),
    )
    return rounded(S.baseline_comparison(panel, T.SETTINGS, other), "spearman_r_vs_primary")


# --- Monte Carlo: the draw is integer arithmetic, stated the same in SQL ----------------


def _mc_sql(iterations: int, seed: int = 42) -> str:
    p, d, place, s = S._PRIME, S._MUL_DRAW, S._MUL_PLACE, S._MUL_SEED
    mix = lambda e, shift: f"(({e}) * ({e}) + ({e}) * {place} + {shift}) % {p}"
    return chain(
        f"""draw0 AS (SELECT i AS iteration, component, weight, (i * {d} + pos * {place} + {seed * s + 1}) % {p} AS h FROM range({iterations}) t(i), reg)""",
        f"draw1 AS (SELECT iteration, component, weight, {mix('h', 12345)} AS h FROM draw0)",
        f"draw2 AS (SELECT iteration, component, weight, {mix('h', 67891)} AS h FROM draw1)",
        f"drawn AS (SELECT iteration, component, weight * (0.7 + 0.6 * (h / {p}::DOUBLE)) AS w FROM draw2)",
        "normed AS (SELECT iteration, component, w / sum(w) OVER (PARTITION BY iteration) AS w FROM drawn)",
        "mc AS (SELECT iteration, fips, 100 + k * sum(value * w) AS score FROM parts JOIN normed USING (component), kval GROUP BY iteration, fips, k)",
        "mc_rank AS (SELECT iteration, fips, rank() OVER (PARTITION BY iteration ORDER BY score) AS r FROM mc)",
        "own AS (SELECT fips, rank() OVER (ORDER BY index_score) AS primary_rank FROM scores)",
    )


@query(
    "monte_carlo_weights",
    steps("scores") + _mc_sql(ITERATIONS) + rounded_sql(
        """SELECT fips, primary_rank, avg(r) AS mean_rank, stddev_pop(r) AS rank_std, quantile_cont(r, 0.05) AS rank_p05, quantile_cont(r, 0.95) AS rank_p95,
        max(r) - min(r) AS max_rank_shift, max(r) - min(r) > 0.15 * (SELECT count(*) FROM scores) AS is_flagged FROM mc_rank JOIN own USING (fips) GROUP BY fips, primary_rank""",
        "mean_rank rank_std rank_p05 rank_p95",
    ),
)
def monte_carlo(spark, d):
    detail = S.monte_carlo_weights(ready(spark, d), T.SETTINGS, ITERATIONS).detail
    return rounded(detail, "mean_rank rank_std rank_p05 rank_p95")


@query(
    "monte_carlo_summary",
    steps("scores") + _mc_sql(ITERATIONS) + rounded_sql(
        """SELECT count(*) AS n_iterations, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.75) AS p75,
        quantile_cont(r, 0.95) AS p95, avg(r) AS mean FROM (SELECT iteration, corr(r, primary_rank) AS r FROM mc_rank JOIN own USING (fips) GROUP BY iteration)""",
        "p05 p25 p50 p75 p95 mean",
    ),
)
def monte_carlo_summary(spark, d):
    return rounded(S.monte_carlo_weights(ready(spark, d), T.SETTINGS, ITERATIONS).summary, "p05 p25 p50 p75 p95 mean")


def _report_part(sql: str, test: str, variant: str, r: str, flagged: str = "n_shifted_gt_10", status: str = "'success'") -> str:
    """One test's own SQL brought to the columns of the report."""
    return f"""SELECT '{test}' AS test_name, CAST({variant} AS VARCHAR) AS variant, CAST({r} AS DOUBLE) AS spearman_r_vs_primary,
        CAST(max_rank_shift AS DOUBLE) AS max_rank_shift, CAST({flagged} AS BIGINT) AS n_flagged_counties, {status} AS status FROM ({sql})"""


_MC_ROW_SQL = steps("scores") + _mc_sql(ITERATIONS) + """
    SELECT r AS spearman, shift AS max_rank_shift, flagged FROM
    (SELECT median(r) AS r FROM (SELECT iteration, corr(mean_place, own_place) AS r FROM
        (SELECT iteration, fips, r + (count(*) OVER (PARTITION BY iteration, r) - 1) / 2.0 AS mean_place FROM mc_rank)
        JOIN (SELECT fips, primary_rank + (count(*) OVER (PARTITION BY primary_rank) - 1) / 2.0 AS own_place FROM own) USING (fips) GROUP BY iteration)),
    (SELECT quantile_cont(s, 0.95) AS shift, count(*) FILTER (WHERE s > 0.15 * (SELECT count(*) FROM scores)) AS flagged
        FROM (SELECT fips, max(r) - min(r) AS s FROM mc_rank GROUP BY fips))"""
_ABSENT_SQL = """SELECT '1991-2020' AS baseline, 1.0 AS r, 0 AS max_rank_shift, 0 AS n, 'primary' AS state
    UNION ALL SELECT '1981-2010', NULL, NULL, NULL, 'data_unavailable'"""


def _report_sql() -> str:
    own = {name: QUERIES[name][1] for name in ("jackknife", "alt_weighting", "normalization_compare", "severity_perturbation", "window_sensitivity")}
    r = "spearman_r_vs_primary"
    parts = [
        _report_part(_MC_ROW_SQL, "weight_perturbation", "'monte_carlo'", "spearman", "flagged"),
        _report_part(own["jackknife"], "jackknife", "'drop_' || excluded_component", "spearman_r"),
        _report_part(own["alt_weighting"], "alt_weighting", "scheme", r),
        _report_part(_sweep_sql((0.5, 0.6, 0.7)), "correlation_threshold", "threshold", r),
        _report_part(own["normalization_compare"], "normalization", "normalization", r),
        _report_part(own["severity_perturbation"], "severity_perturbation", "perturbation_factor", r),
        _report_part(own["window_sensitivity"], "window_sensitivity", "window_years", r, "0"),
        _report_part(_ABSENT_SQL, "baseline_comparison", "baseline", "r", "n", "state"),
    ]
    return rounded_sql("\nUNION ALL ".join(parts), r)


@query("sensitivity_report", _report_sql())
def sensitivity_report(spark, d):
    """All tests in one table."""
    return rounded(S.sensitivity_report(T.panel(spark, d), T.SETTINGS, ITERATIONS), "spearman_r_vs_primary")


@query(
    "robustness_label",
    steps("scores") + JACK_SQL + rounded_sql(
        """SELECT min(spearman_r) AS min_spearman_r, CASE WHEN min(spearman_r) > 0.9 THEN 'robust' WHEN min(spearman_r) > 0.8 THEN 'moderately_robust' ELSE 'fragile' END AS robustness
        FROM agree WHERE spearman_r < 1""",
        "min_spearman_r",
    ),
)
def robustness_label(spark, d):
    table = S.jackknife(ready(spark, d), T.SETTINGS)
    rows = S.report_rows(table, "jackknife", F.col("excluded_component"), "spearman_r")
    return rounded(S.robustness_label(rows), "min_spearman_r")


@query(
    "self_pair_join",
    T.with_roles("panel") + """
    SELECT y.year, n AS next_year, count(*) AS n_units FROM (SELECT year, lead(year) OVER (ORDER BY year) AS n FROM (SELECT DISTINCT year FROM panel)) y
    JOIN panel p ON p.year = y.year JOIN panel q ON q.year = y.n AND q.fips = p.fips GROUP BY ALL""",
)
def self_pair_join(spark, d):
    panel = T.panel(spark, d).select("fips", "year")
    later = panel.withColumnRenamed("year", "next_year")
    return panel.join(year_pairs(panel), "year").join(later, ["fips", "next_year"]).groupBy("year", "next_year").agg(
        F.count(F.lit(1)).alias("n_units")
    )


