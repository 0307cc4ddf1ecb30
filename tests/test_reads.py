"""Steps that read their input once, however many results use it."""

from hearthline import params as P
from hearthline.bindings import flow, scoring
from hearthline.operators import windows
from hearthline.plans import harmonize as H
from hearthline.plans import index as I

SMALL = "/root/testdata/sf0.001"


def counted(spark, df):
    """The rows of ``df`` and a counter of how often one of them is computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def test_component_tables_share_one_stored_panel(spark):
    files = {f for table in flow.component_tables(spark, SMALL).values() for f in table.inputFiles()}
    assert files and not any("lineitem" in f for f in files)


def test_gap_fill_computes_its_panel_once(spark):
    rows = [(f"{i:05d}", 2000, 5.0 if i % 3 else None) for i in range(12)]
    panel, seen = counted(spark, spark.createDataFrame(rows, "fips string, year int, pm25_annual double"))
    centres = spark.createDataFrame([(f"{i:05d}", 40.0 + i / 100, -90.0) for i in range(12)], "fips string, lat double, lon double")
    filled = H.idw_gap_fill(panel, centres).collect()
    assert [round(r.pm25_annual, 9) for r in filled] == [5.0] * 12 and sum(r.pm25_annual__gap_filled for r in filled) == 4
    assert seen.value == 12


def test_trend_step_computes_its_panel_once(spark):
    rows = [(c, f"{i:05d}", y, float(i * y % 7 + i)) for c in ("storm_severity", "pm25_annual") for i in range(6) for y in range(1994, 2001)]
    long = spark.createDataFrame(rows, "component string, fips string, year int, value double")
    wide = long.groupBy("fips", "year").pivot("component", ["storm_severity", "pm25_annual"]).sum("value")
    panel, seen = counted(spark, wide)
    panel = I.with_scenario(panel)
    once = I.accelerations(panel, ["storm_severity", "pm25_annual"], P.Settings(scoring_year=2000), P.registry_frame(spark))
    assert once.count() == 12 and once.where("acceleration is not null").count() == 12
    # The points, and the years that occur.
    assert seen.value <= 2 * 42


def test_several_windows_in_one_run_equal_single_runs(spark):
    rows = [(c, f"{i:05d}", "p", y, float(i * y % 5 - i)) for c in ("storm_severity", "pm25_annual") for i in range(5) for y in range(1994, 2001) if (i + y) % 4]
    long = spark.createDataFrame(rows, "component string, fips string, scenario string, year int, value double")
    spans = spark.createDataFrame([(c, w) for c in ("storm_severity", "pm25_annual") for w in (2, 4, 7)], "component string, window int")
    together = windows.window_slopes(long, spans, 2000, I.UNIT)
    for w in (2, 4, 7):
        alone = windows.theil_sen(long, spans.where(f"window = {w}"), 2000, I.UNIT)
        mine = together.where(f"window = {w}").select(*alone.columns)
        assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)


def test_correlations_take_no_trends(spark, monkeypatch):
    def unused(*_):
        raise AssertionError("correlations do not depend on trends")

    monkeypatch.setattr(I, "accelerations", unused)
    assert scoring.correlation_robustness(spark, SMALL).count() > 0
