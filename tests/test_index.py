"""Boundary semantics of the scoring steps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.operators import windows
from hearthline.plans import index as I
from hearthline.plans import scenarios as S
from hearthline.plans import validation as V

YEARS = range(2019, 2025)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(123)
    rows = [
        {"fips": f"{1 + i // 10:02d}{i:03d}", "year": y, **{c: float(v) for c, v in zip(P.COMPONENT_IDS, rng.uniform(1, 100, 12))}}
        for i in range(20) for y in YEARS
    ]
    return spark.createDataFrame(pd.DataFrame(rows)).withColumn("year", F.col("year").cast("int")).cache()


def pairs(spark, rows):
    return spark.createDataFrame([("p", a, b, r) for a, b, r in rows], "scenario string, a string, b string, r double")


def test_threshold_is_strict_and_floor_holds(spark):
    table = pairs(spark, [("hdd_anomaly", "storm_severity", 0.6), ("pm25_annual", "storm_severity", -0.95), ("storm_severity", "wildfire_score", 0.7)])
    flagged = I.flagged_pairs(table, 0.6)
    assert {(r.winner, r.loser) for r in flagged.collect()} == {("pm25_annual", "storm_severity"), ("storm_severity", "wildfire_score")}
    got = {r.component: r.penalty for r in I.overlap_penalties(flagged, 0.2).collect()}
    assert got["storm_severity"] == 0.2 and got["wildfire_score"] == pytest.approx(0.51)


def test_alternative_methods_flag_conservatively(spark):
    table = pairs(spark, [("hdd_anomaly", "storm_severity", 0.3)])
    other = pairs(spark, [("hdd_anomaly", "storm_severity", 0.9)])
    assert I.flagged_pairs(table, 0.6).count() == 0
    assert I.flagged_pairs(table, 0.6, other).first().raw_penalty == pytest.approx(0.91)


def slope_rows(spark, values):
    rows = [("p", f, y, "pm25_annual", v) for f, series in values.items() for y, v in series.items()]
    return spark.createDataFrame(rows, "scenario string, fips string, year int, component string, value double")


def test_theil_sen_completeness(spark):
    full = {y: 2.0 * y for y in range(2020, 2025)}
    four = {y: 3.0 * y for y in range(2021, 2025)}
    three = {y: 1.0 * y for y in range(2022, 2025)}
    got = {
        r.fips: r.slope
        for r in windows.theil_sen(slope_rows(spark, {"a": full, "b": four, "c": three}), P.registry_frame(spark), 2024, I.UNIT).collect()
    }
    assert got == {"a": pytest.approx(2.0), "b": pytest.approx(3.0), "c": None}


def test_single_year_gives_zero_slope(spark):
    got = windows.theil_sen(slope_rows(spark, {"a": {2024: 5.0}}), P.registry_frame(spark), 2024, I.UNIT).first()
    assert got.slope == 0.0


def multipliers(spark, slopes):
    rows = spark.createDataFrame([("p", str(i), "c", v) for i, v in enumerate(slopes)], "scenario string, fips string, component string, slope double")
    got = windows.acceleration_multipliers(rows, ["scenario"], 0.5, 3.0, 0.1).toPandas()
    return got.set_index("fips").acceleration.sort_index().tolist()


def test_multiplier_forms(spark):
    assert multipliers(spark, [1.0, 1.0, 1.0]) == [1.0, 1.0, 1.0]
    assert multipliers(spark, [1.0, 2.0, 4.0, None]) == [0.5, 1.0, 2.0, 1.0]
    sigma = float(np.std([-1.0, 0.0, 1.0], ddof=1))
    assert multipliers(spark, [-1.0, 0.0, 1.0]) == pytest.approx([0.5, 1.0, 1 + 1 / sigma])


def test_winsorize_precedes_universe(spark, panel):
    """The cut uses every county of the year, also those outside the universe."""
    rare = panel.where("year = 2024").withColumn("drought_score", F.when(F.col("fips") != "01000", F.col("drought_score")))
    rare = rare.withColumn("pm25_annual", F.when(F.col("fips") == "01000", F.lit(1e6)).otherwise(F.col("pm25_annual")))
    inside = I.winsorized_universe(I.with_scenario(rare), P.Settings())
    assert inside.where("fips = '01000'").count() == 0
    values = rare.toPandas().pm25_annual
    top = inside.where("component = 'pm25_annual'").agg(F.max("value")).first()[0]
    assert top == pytest.approx(min(np.percentile(values, 99), sorted(values)[-2]))


def test_index_spread_and_bundle(spark, panel):
    census = panel.where("year = 2024").select("fips", "year", F.lit(10.0).alias("total_housing_units"), F.lit(50.0).alias("median_household_income"))
    result = I.compute_index(panel, P.Settings(), census)
    scores = result.scores.toPandas()
    assert len(scores) == 20 and set(scores.data_quality_tier) == {"gold"}
    q1, q3 = np.percentile(scores.index_score, [25, 75])
    assert q3 - q1 == pytest.approx(40.0)
    assert result.national.first().national == pytest.approx(scores.raw_composite.mean())
    assert result.strain.toPandas().index_strain.median() == pytest.approx(100.0)
    frozen = I.compute_index(panel, P.Settings(), k=spark.createDataFrame([("primary", 1.873)], "scenario string, k double"))
    got = frozen.scores.toPandas()
    assert np.allclose(got.index_score, 100 + 1.873 * got.raw_composite)


def test_rank_comparison_of_identical_scores(spark, panel):
    scores = panel.where("year = 2024").select("fips", F.col("pm25_annual").alias("index_score"))
    got = S.compare_rankings(scores, scores.withColumn("scenario", F.lit("same"))).first()
    assert got.spearman_r == pytest.approx(1.0) and got.kendall_tau == pytest.approx(1.0) and got.max_rank_shift == 0


def test_jackknife_and_monte_carlo_shapes(spark, panel):
    ready = I.prepare(panel, P.Settings())
    assert S.jackknife(ready, P.Settings()).count() == 12
    run = S.monte_carlo_weights(ready, P.Settings(), 40)
    detail = run.detail.toPandas()
    assert len(detail) == 20 and detail.mean_rank.sum() == pytest.approx(210.0)
    assert run.summary.first().n_iterations == 40
    still = S.monte_carlo_weights(ready, P.Settings(), 5, 0.0).detail.toPandas()
    assert (still.max_rank_shift == 0).all() and (still.rank_std == 0).all()


def test_perturbed_weights_sum_to_one(spark):
    rows = S.perturbed_weights(spark, P.base_weights(), 100, 0.3).collect()
    assert all(sum(r.weights) == pytest.approx(1.0) for r in rows)
    assert len({round(r.weights[0], 9) for r in rows}) > 90


def test_baseline_without_data(spark, panel):
    got = {r.baseline: r.status for r in S.baseline_comparison(panel, P.Settings()).collect()}
    assert got == {"1991-2020": "primary", "1981-2010": "data_unavailable"}


def test_pvalues_match_tables(spark):
    """Critical values of r for a two-sided 5 % and 1 % test."""
    from hearthline.functions.pvalues import correlation_pvalue

    rows = spark.createDataFrame([(0.6319, 10), (0.7646, 10), (0.4438, 20), (0.1966, 100), (0.5, 2)], "r double, n long")
    got = [r[0] for r in rows.select(correlation_pvalue(F.col("r"), F.col("n"))).collect()]
    assert got[:4] == [pytest.approx(0.05, abs=2e-4), pytest.approx(0.01, abs=1e-4), pytest.approx(0.05, abs=2e-4), pytest.approx(0.05, abs=2e-4)]
    assert got[4] is None


def test_stability_guards(spark):
    lacking = V.stability_report(spark.createDataFrame([("a", 1)], "fips string, year int"))
    assert lacking.first().status == "missing_columns"
    single = V.stability_report(spark.createDataFrame([("a", 2020, 1.0)], "fips string, year int, index_score double"))
    assert single.first().status == "insufficient_years"


def test_stable_scores_pass(spark):
    rng = np.random.default_rng(42)
    base = rng.normal(100, 15, 100)
    rows = [(f"{i:05d}", y, float(b + rng.normal(0, 2))) for y in (2023, 2024) for i, b in enumerate(base)]
    report = V.stability_report(spark.createDataFrame(rows, "fips string, year int, index_score double")).toPandas().set_index("metric")
    assert report.loc["rank_persistence", "passes"] and report.loc["rank_persistence", "value"] > 0.9
    assert report.loc["score_band_stability", "status"] == "insufficient_years"
    assert report.loc["component_contribution_stability", "status"] == "no_component_data"


def test_census_of_several_years_gives_one_row_per_county(spark, panel):
    one = panel.where("year = 2024").select("fips", "year", F.lit(10.0).alias("total_housing_units"), F.lit(50.0).alias("median_household_income"))
    several = one.unionByName(one.withColumn("year", F.lit(2022))).unionByName(one.withColumn("year", F.lit(2030)))
    result = I.compute_index(panel, P.Settings(), several)
    assert result.strain.count() == one.count()


def test_year_pairs_without_common_counties_keep_their_row(spark):
    rows = [(f"0100{i}", 2020, float(i)) for i in range(4)] + [(f"0200{i}", 2021, float(i)) for i in range(4)]
    got = V.rank_persistence(spark.createDataFrame(rows, "fips string, year int, index_score double")).collect()
    assert [(r["year_pair"], r["n"], r["spearman_r"]) for r in got] == [("2020-2021", 0, None)]
