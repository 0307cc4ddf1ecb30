"""External, convergent and stability validation of the scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import columns as C
from hearthline.functions.pvalues import correlation_pvalue
from hearthline.operators import rollups, stats, windows
from hearthline.operators.joins import year_pairs
from hearthline.operators.order_stats import quantiles
from hearthline.storage import materialize

EXTERNAL_SCHEMA = (
    "indicator string, geographic_level string, pearson_r double, spearman_r double, p_value_pearson double, "
    "p_value_spearman double, n_observations long, expected_r_low double, expected_r_high double, "
    "within_expected boolean, status string, note string"
)
# Indicator, level, expected range, whether the sign counts, note.
INDICATORS = (
    ("fema_ia_per_household", "county", 0.3, 0.6, False, ""),
    ("energy_bill_volatility", "county", 0.3, 0.5, False, "state-level source; counties of a state share it"),
    ("net_domestic_migration", "county", -0.3, -0.1, True, "population change stands in for migration"),
    ("insurance_premium_growth", "state", 0.3, 0.5, False, "source not available"),
    ("property_value_volatility", "county", 0.2, 0.4, False, "source not available"),
    ("utility_rate_case_frequency", "state", 0.2, 0.4, False, "source not available"),
)


def correlation_test(
    pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Pearson and Spearman with p-values per group; fewer than three rows give NULL."""
    both = stats.pearson_and_spearman(pairs, keys, x, y)
    enough = F.col("n") >= 3
    return both.select(
        *keys,
        F.when(enough, F.col("pearson_r")).alias("pearson_r"),
        F.when(enough, F.col("spearman_r")).alias("spearman_r"),
        correlation_pvalue(F.col("pearson_r"), F.col("n")).alias("p_value_pearson"),
        correlation_pvalue(F.col("spearman_r"), F.col("n")).alias("p_value_spearman"),
        F.col("n").alias("n_observations"),
    )


def external_validation(
    scored: DataFrame, panel: DataFrame | None, census: DataFrame | None, scoring_year: int
) -> DataFrame:
    """Six indicators against the scores; those without a source say so."""
    spark = scored.sparkSession
    expected = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(INDICATORS)],
        "position int, indicator string, geographic_level string, expected_r_low double, expected_r_high double, "
        "signed boolean, note string",
    )
    series = []
    if panel is not None and "fema_ia_burden" in panel.columns:
        paid = panel.where(F.col("year") == scoring_year).groupBy("fips").agg(F.avg("fema_ia_burden").alias("y"))
        series.append(paid.withColumn("indicator", F.lit("fema_ia_per_household")))
    if panel is not None and "energy_cost_attributed" in panel.columns:
        swings = rollups.volatility(panel, "energy_cost_attributed", scoring_year)
        series.append(swings.select("fips", F.col("volatility").alias("y"), F.lit("energy_bill_volatility").alias("indicator")))
    if census is not None:
        growth = rollups.growth_rate(census, "population")
        series.append(growth.select("fips", F.col("growth").alias("y"), F.lit("net_domestic_migration").alias("indicator")))
    if not series:
        tested = spark.createDataFrame([], "indicator string, pearson_r double, spearman_r double, "
                                       "p_value_pearson double, p_value_spearman double, n_observations long")
    else:
        stacked = reduce(lambda a, b: a.unionByName(b), series)
        matched = stacked.join(scored.select("fips", F.col("index_score").alias("x")), "fips")
        tested = correlation_test(matched, ["indicator"])
    size = F.when(F.col("signed"), F.col("pearson_r")).otherwise(F.abs("pearson_r"))
    status = (
        F.when(F.col("n_observations").isNull(), F.lit("data_unavailable"))
        .when(F.col("n_observations") < 3, F.lit("insufficient_data"))
        .otherwise(F.lit("success"))
    )
    return expected.join(tested, "indicator", "left").select(
        "indicator", "geographic_level", "pearson_r", "spearman_r", "p_value_pearson", "p_value_spearman",
        "n_observations", "expected_r_low", "expected_r_high",
        size.between(F.col("expected_r_low"), F.col("expected_r_high")).alias("within_expected"),
        status.alias("status"), "note",
    )


def convergent_divergent(scored: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    """Two rows per benchmark: correlated enough, but no duplicate."""
    spark = scored.sparkSession
    targets = spark.createDataFrame(
        [
            ("fema_nri", "convergent", 0.4, 0.7, True),
            ("fema_nri", "divergent", 0.0, 0.85, False),
            ("first_street", "convergent", 0.4, 0.7, True),
            ("first_street", "divergent", 0.0, 0.85, False),
        ],
        "benchmark string, validity_type string, target_r_low double, target_r_high double, closed boolean",
    )
    if benchmark is None:
        tested = spark.createDataFrame([], "benchmark string, pearson_r double, spearman_r double, p_value_pearson double, "
                                       "p_value_spearman double, n_observations long")
    else:
        matched = scored.select("fips", F.col("index_score").alias("x")).join(
            benchmark.select("fips", F.col("nri_score").alias("y"), F.lit("fema_nri").alias("benchmark")), "fips"
        )
        tested = correlation_test(matched, ["benchmark"])
    size = F.abs("pearson_r")
    within = F.when(F.col("closed"), size.between(F.col("target_r_low"), F.col("target_r_high"))).otherwise(
        size < F.col("target_r_high")
    )
    status = (
        F.when(F.col("n_observations").isNull(), F.lit("data_unavailable"))
        .when(F.col("n_observations") < 3, F.lit("insufficient_data"))
        .otherwise(F.lit("success"))
    )
    return targets.join(tested, "benchmark", "left").select(
        "benchmark", "validity_type", "pearson_r", "spearman_r", "p_value_pearson", "p_value_spearman", "n_observations",
        "target_r_low", "target_r_high",
        within.alias("within_target"), C.interpret_correlation(F.col("pearson_r")).alias("interpretation"),
        status.alias("status"),
    )


# --- stability ---------------------------------------------------------------------


def _pair_label() -> Column:
    return F.concat_ws("-", F.col("year").cast("string"), F.col("next_year").cast("string"))


def paired_scores(scores: DataFrame) -> DataFrame:
    """Scores of counties present in consecutive years: ``year_pair, fips, x, y``."""
    following = scores.select(F.col("year").alias("next_year"), "fips", F.col("index_score").alias("y"))
    return (
        scores.join(year_pairs(scores), "year")
        .join(following, ["next_year", "fips"])
        .select(_pair_label().alias("year_pair"), "fips", F.col("index_score").alias("x"), "y")
    )


def rank_persistence(scores: DataFrame) -> DataFrame:
    """Rank correlation of consecutive years with its interval; passes above 0.9."""
    found = stats.spearman(paired_scores(scores), ["year_pair"])
    # Consecutive years without a common county keep their row, with n = 0.
    both = year_pairs(scores).select(_pair_label().alias("year_pair")).join(found, "year_pair", "left")
    both = both.withColumn("n", F.coalesce("n", F.lit(0)))
    r = F.when(F.col("n") >= 3, F.col("r"))
    return both.select(
        "year_pair",
        r.alias("spearman_r"),
        C.fisher_bound(r, F.col("n"), -1).alias("ci_low"),
        C.fisher_bound(r, F.col("n"), 1).alias("ci_high"),
        (r > 0.9).alias("passes"),
        "n",
    )


def decile_turnover(scores: DataFrame) -> DataFrame:
    """Share of the top and bottom tenth that leaves it by the next year; passes below 20 %."""
    pairs = paired_scores(scores)
    levels = {"low": 0.1, "high": 0.9}
    cuts_x = quantiles(pairs, ["year_pair"], "x", {f"x_{n}": p for n, p in levels.items()})
    cuts_y = quantiles(pairs, ["year_pair"], "y", {f"y_{n}": p for n, p in levels.items()})
    placed = pairs.join(cuts_x, "year_pair").join(cuts_y, "year_pair")
    top = (F.col("x") >= F.col("x_high"), F.col("y") >= F.col("y_high"))
    bottom = (F.col("x") <= F.col("x_low"), F.col("y") <= F.col("y_low"))
    leaving = lambda side: F.try_divide(F.count_if(side[0] & ~side[1]) * 100.0, F.count_if(side[0]))
    both = placed.groupBy("year_pair").agg(
        F.count(F.lit(1)).alias("_n"), leaving(top).alias("top"), leaving(bottom).alias("bottom")
    )
    return both.unpivot(["year_pair", "_n"], ["top", "bottom"], "decile", "_share").select(
        "year_pair",
        "decile",
        F.when(F.col("_n") >= 10, F.col("_share")).alias("turnover_pct"),
        F.lit(20.0).alias("threshold"),
        F.when(F.col("_n") >= 10, F.col("_share") < 20.0).alias("passes"),
    )


def contribution_stability(multi_year: DataFrame, components: list[str]) -> DataFrame:
    """Rank correlation of a county's component sizes between years, and its driver.

    The twelve components of a county-year are ranked inside one small array
    group, so nothing larger than a county is ever sorted.
    """
    driver = windows.argmax_driver(multi_year, components)
    current = multi_year.select("fips", "year", driver.alias("driver"), *components)
    later = current.select(
        "fips", F.col("year").alias("next_year"), F.col("driver").alias("driver2"),
        *[F.col(c).alias(f"{c}__2") for c in components],
    )
    label = F.concat_ws("-", F.col("year").cast("string"), F.col("next_year").cast("string"))
    joined = (
        current.join(year_pairs(current), "year")
        .join(later, ["fips", "next_year"])
        .where(F.col("driver").isNotNull() & F.col("driver2").isNotNull())
    )
    first = F.array(*[F.abs(F.col(c)) for c in components])
    second = F.array(*[F.abs(F.col(f"{c}__2")) for c in components])
    ranks = joined.select(
        "fips", label.alias("year_pair"), "driver", "driver2",
        _array_ranks(first).alias("_r1"), _array_ranks(second).alias("_r2"),
    )
    complete = ranks.withColumn(
        "_both",
        F.filter(
            F.arrays_zip("_r1", "_r2"), lambda e: e["_r1"].isNotNull() & e["_r2"].isNotNull()
        ),
    )
    # Spearman ranks the common components again, as the pairs with a gap drop out.
    xs = _array_ranks(F.transform("_both", lambda e: e["_r1"]))
    ys = _array_ranks(F.transform("_both", lambda e: e["_r2"]))
    reranked = complete.withColumns({"_x": xs, "_y": ys})
    return reranked.select(
        "fips",
        "year_pair",
        F.when(F.size("_both") >= 3, _array_pearson(F.col("_x"), F.col("_y"))).alias("component_rank_spearman_r"),
        F.col("driver").alias("primary_driver_year1"),
        F.col("driver2").alias("primary_driver_year2"),
        (F.col("driver") != F.col("driver2")).alias("driver_changed"),
    )


def _array_ranks(values: Column) -> Column:
    """Descending average ranks of a short array; NULL stays NULL."""

    def rank(v):
        above = F.size(F.filter(values, lambda o: o > v))
        equal = F.size(F.filter(values, lambda o: o == v))
        return F.when(v.isNotNull(), above + (equal + 1) / 2.0)

    return F.transform(values, rank)


def _array_pearson(x: Column, y: Column) -> Column:
    """Pearson correlation of two short arrays without gaps."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.size(x)
    mx, my = total(x) / n, total(y) / n
    cov = total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
    vx = total(F.transform(x, lambda a: (a - mx) * (a - mx)))
    vy = total(F.transform(y, lambda b: (b - my) * (b - my)))
    return F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))


STABILITY_SCHEMA = (
    "metric string, year_pair string, value double, threshold double, passes boolean, status string, note string"
)


def _note_row(spark: SparkSession, metric: str, status: str, note: str) -> DataFrame:
    return spark.createDataFrame([(metric, "N/A", None, None, None, status, note)], STABILITY_SCHEMA)


def stability_report(multi_year: DataFrame) -> DataFrame:
    """All stability metrics in common columns, with rows saying what was not possible."""
    spark = multi_year.sparkSession
    missing = sorted({"fips", "year", "index_score"} - set(multi_year.columns))
    if missing:
        return _note_row(spark, "all", "missing_columns", f"Missing required columns: {missing}")
    # Every metric reads the scores.
    multi_year = materialize(multi_year, "multi_year")
    years = multi_year.select("year").distinct().count()
    if years < 2:
        return _note_row(spark, "all", "insufficient_years", f"Stability analysis requires >=2 years. Found {years}.")
    scores = multi_year.select("fips", "year", "index_score")
    verdict = F.when(F.col("passes").isNull(), F.lit("insufficient_data")).otherwise(F.lit("success"))
    interval = F.when(
        F.col("ci_low").isNotNull(), F.format_string("CI=[%.3f, %.3f]", F.col("ci_low"), F.col("ci_high"))
    ).otherwise(F.lit(""))
    persistence = rank_persistence(scores).select(
        F.lit("rank_persistence").alias("metric"), "year_pair", F.col("spearman_r").alias("value"),
        F.lit(0.9).alias("threshold"), "passes", verdict.alias("status"), interval.alias("note"),
    )
    turnover = decile_turnover(scores).select(
        F.concat(F.lit("decile_turnover_"), "decile").alias("metric"), "year_pair",
        F.col("turnover_pct").alias("value"), "threshold", "passes", verdict.alias("status"), F.lit("").alias("note"),
    )
    rows = persistence.unionByName(turnover)
    no_number, no_verdict = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    if years < 5:
        rows = rows.unionByName(
            _note_row(spark, "score_band_stability", "insufficient_years", f"Band stability requires >=5 years. Found {years}.")
        )
    else:
        high = F.count_if(F.col("stability_class") == "high_stability")
        low = F.count_if(F.col("stability_class") == "low_stability")
        all_of = F.count(F.lit(1))
        rows = rows.unionByName(
            windows.score_bands(scores, "index_score").agg(
                F.lit("score_band_stability").alias("metric"), F.lit("trailing_5yr").alias("year_pair"),
                F.try_divide(high * 100.0, all_of).alias("value"), no_number.alias("threshold"),
                no_verdict.alias("passes"), F.lit("success").alias("status"),
                F.format_string("%d high-stability, %d low-stability out of %d counties", high, low, all_of).alias("note"),
            )
        )
    components = [c for c in P.COMPONENT_IDS if c in multi_year.columns]
    if not components:
        return rows.unionByName(
            _note_row(spark, "component_contribution_stability", "no_component_data", "No component columns found")
        )
    changed, all_of = F.count_if("driver_changed"), F.count(F.lit(1))
    some = all_of > 0
    changes = F.format_string("%d/%d counties changed primary driver", changed, all_of)
    return rows.unionByName(
        contribution_stability(multi_year, components).agg(
            F.lit("component_contribution_stability").alias("metric"),
            F.when(some, F.lit("all")).otherwise(F.lit("N/A")).alias("year_pair"),
            F.avg("component_rank_spearman_r").alias("value"), no_number.alias("threshold"), no_verdict.alias("passes"),
            F.when(some, F.lit("success")).otherwise(F.lit("no_component_data")).alias("status"),
            F.when(some, changes).otherwise(F.lit("No comparable county-years found")).alias("note"),
        )
    )


SKIPPED = ("data_unavailable", "no_multi_year_data", "no_scored_data", "insufficient_years", "no_component_data")


def validation_report(external: DataFrame, convergent: DataFrame, stability: DataFrame | None) -> DataFrame:
    """All tests as ``(test_category, test_name, result, threshold, passes, status)``."""
    span = lambda low, high: F.format_string("[%s, %s]", F.col(low).cast("string"), F.col(high).cast("string"))
    rows = external.select(
        F.lit("external_criteria").alias("test_category"), F.col("indicator").alias("test_name"),
        F.col("pearson_r").alias("result"), span("expected_r_low", "expected_r_high").alias("threshold"),
        F.col("within_expected").alias("passes"), "status",
    ).unionByName(
        convergent.select(
            F.lit("convergent_divergent").alias("test_category"),
            F.concat_ws("_", "benchmark", "validity_type").alias("test_name"),
            F.col("pearson_r").alias("result"), span("target_r_low", "target_r_high").alias("threshold"),
            F.col("within_target").alias("passes"), "status",
        )
    )
    if stability is None:
        stability = _note_row(
            external.sparkSession, "all", "no_multi_year_data", "Stability requires multi-year scores."
        )
    return rows.unionByName(
        stability.select(
            F.lit("stability").alias("test_category"), F.col("metric").alias("test_name"), F.col("value").alias("result"),
            F.col("threshold").cast("string").alias("threshold"), "passes", "status",
        )
    )


def report_counts(report: DataFrame) -> DataFrame:
    """Passed, failed, skipped and errored tests of a report."""
    return report.agg(
        F.count_if("passes").alias("n_passed"),
        F.count_if(~F.col("passes") & (F.col("status") == "success")).alias("n_failed"),
        F.count_if(F.col("status").isin(*SKIPPED)).alias("n_skipped"),
        F.count_if(F.col("status") == "failed").alias("n_errored"),
    )
