"""Published results, names, p-values and incremental loading."""

import math

import pytest
from pyspark.sql import functions as F

from hearthline.functions.columns import normalize_county_name
from hearthline.functions.pvalues import correlation_pvalue
from hearthline.plans import scenarios as S
from hearthline.sources import sinks as W


def test_names_lose_marks_of_any_letter_and_keep_letters_of_their_own(spark):
    names = {
        "Doña Ana (County)": "dona ana", "Ǎḍṁ Vĩnh": "adm vinh", "Bế Ṅorth": "be north", "Łódź": "łodz", "Đà Nẵng": "đa nang",
        "éą": "ea", "St. Müße": "saint muße", None: None,
    }
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = [r[0] for r in rows.orderBy("i").select(normalize_county_name(F.col("name"))).collect()]
    assert got == list(names.values())


def test_pvalues_by_numeric_integration(spark):
    def integrated(r, n, parts=20_000):
        # Density of r over n pairs without correlation is proportional to (1 - r^2)^((n - 4) / 2); by angle it is smooth.
        f = lambda a: math.cos(a) ** (n - 3)
        area = lambda lo, hi: sum(f(lo + (hi - lo) * (i + 0.5) / parts) for i in range(parts)) * (hi - lo) / parts
        return area(math.asin(abs(r)), math.pi / 2) / area(0, math.pi / 2)

    cases = [(r, n) for n in (3, 4, 5, 6, 7, 30, 101, 1000) for r in (0.0, 0.05, -0.3, 0.7, -0.999)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r double, n long")
    got = [x[0] for x in rows.orderBy("i").select(correlation_pvalue(F.col("r"), F.col("n"))).collect()]
    for p, (r, n) in zip(got, cases):
        assert p == pytest.approx(integrated(r, n), abs=5e-7), (r, n)
    odd = spark.createDataFrame([(1.0, 10), (-1.0, 3), (0.5, 2), (None, 9), (float("nan"), 9), (1.0000000001, 8)], "r double, n long")
    assert [x[0] for x in odd.select(correlation_pvalue(F.col("r"), F.col("n"))).collect()] == [0.0, 0.0, None, None, None, 0.0]


def test_bundle_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    one = spark.range(3).toDF("a")
    W.write_bundle({"x": one, "y": one}, root, spark.range(1).select(F.lit(2.5).alias("k")), label="first")
    broken = one.select((F.raise_error(F.lit("broken"))).alias("a"))
    with pytest.raises(Exception):
        W.write_bundle({"x": spark.range(9).toDF("a"), "y": broken}, root, label="second")
    tables, facts = W.read_bundle(spark, root)
    assert (tables["x"].count(), tables["y"].count(), facts) == (3, 3, {"k": 2.5, "label": "first"})
    W.write_bundle({"x": spark.range(5).toDF("a")}, root, label="third")
    tables, facts = W.read_bundle(spark, root)
    assert list(tables) == ["x"] and tables["x"].count() == 5 and facts == {"label": "third"}


def test_rows_of_more_than_a_hundred_batches_are_counted(spark, tmp_path):
    from hearthline.streaming.incremental import incremental_year_load

    source, target, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))
    rows = spark.range(1040).select("id", (F.lit(2000) + F.col("id") % 3).cast("int").alias("year"))
    rows.repartition(104).write.parquet(source)
    load = lambda: incremental_year_load(spark, source, rows.schema, target, seen, lambda df: df.where("id % 2 = 0"), files_per_batch=1)
    assert load() == 520
    assert load() == 0
    assert spark.read.parquet(target).count() == 520


def test_draws_rank_ties_like_a_window(spark):
    from pyspark.sql import Window

    rows = [(d, u, float((u * 7 + d) % 4 if u % 3 else u)) for d in range(6) for u in range(40)]
    flat = spark.createDataFrame(rows, "iteration int, unit int, score double")
    orders = flat.groupBy("iteration").agg(F.array_sort(F.collect_list(F.struct("score", "unit"))).alias("order"))
    got = {(r["iteration"], r["unit"]): (r["rank"], r["mean_place"]) for r in S.ranked_draws(orders.cache()).collect()}
    order = Window.partitionBy("iteration").orderBy("score")
    ties = F.count(F.lit(1)).over(order.rangeBetween(0, 0))
    want = flat.select("*", F.rank().over(order).alias("rank"), ties.alias("n")).collect()
    assert len(got) == len(rows)
    assert got == {(r["iteration"], r["unit"]): (r["rank"], r["rank"] + (r["n"] - 1) / 2) for r in want}


def test_leaving_one_out_is_scaling_the_others(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = [("1", "a", 4.0), ("1", "b", -2.0), ("1", "c", 1.0), ("2", "a", 3.0), ("2", "c", 5.0), ("3", "b", 1.0)]
    got = {(r["scenario"], r["fips"]): r["raw_composite"] for r in S.left_out(spark.createDataFrame(rows, "fips string, component string, value double"), weights).collect()}
    for scheme, scaled in S.jackknife_schemes(weights).items():
        for fips in "123":
            assert got[scheme, fips] == pytest.approx(sum(scaled[c] * v for f, c, v in rows if f == fips))
    assert len(got) == 9


def test_equal_counties_have_equal_composites_in_any_row_order(spark):
    """F7, F16: normalization_compare and compare_rankings rank these sums."""
    from hearthline import params as P
    from hearthline.plans import index as I

    values = [("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 1e16), ("e", -1e16)]
    rows = [("s", "1", c, v) for c, v in values] + [("s", "2", c, v) for c, v in values[::-1]]
    rows += [("s", "3", c, v) for c, v in values[2:] + values[:2]] + [("s", "4", "a", 9.0), ("s", "5", "b", None)]
    scores = spark.createDataFrame(rows, "scenario string, fips string, component string, score double").coalesce(1)
    one = spark.createDataFrame([("s", 1.0)], "scenario string, k double")
    got = {r["fips"]: r["raw_composite"] for r in I.composite(scores, P.Settings(), one)[0].collect()}
    assert got["1"] == got["2"] == got["3"]
    assert got["4"] == 9.0 and got["5"] is None
    weights = {c: 0.2 for c, _ in values}
    parts = scores.where("fips < '4'").select("fips", "component", F.col("score").alias("value"))
    left = {(r["scenario"], r["fips"]): r["raw_composite"] for r in S.left_out(parts, weights).collect()}
    assert all(left[c, "1"] == left[c, "2"] == left[c, "3"] for c in weights)


def test_shares_of_a_year_do_not_bring_its_rows_into_one_task(spark):
    """scan_expenditure_table has two years, and one task read all their rows."""
    from hearthline.operators import rollups

    is_total = F.col("category") == "all"
    rows = [(2022, "all", 50.0), (2022, "a", 5.0), (2022, "b", None), (2023, "a", 4.0), (2024, "all", 0.0), (None, "all", 3.0)]
    few = spark.createDataFrame(rows, "year int, category string, annual_expenditure double")
    got = {(r["year"], r["category"]): r["pct_of_total"] for r in rollups.pct_of_total(few, is_total).collect()}
    assert got == {(2022, "all"): 100.0, (2022, "a"): 10.0, (2022, "b"): 0.0, (2023, "a"): 0.0, (2024, "all"): 0.0, (None, "all"): 0.0}
    many = spark.range(50_000_000).select(
        (2022 + F.col("id") % 2).cast("int").alias("year"), F.when(F.col("id") > 1, "a").otherwise("all").alias("category"),
        F.col("id").cast("double").alias("annual_expenditure"),
    )
    plan = rollups.pct_of_total(many, is_total)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" in plan
