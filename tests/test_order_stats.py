"""Both forms of ranks and quantiles against pandas, with heavy ties."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.operators import order_stats as O
from hearthline.operators import stats as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    frames = []
    for key, n in (("a", 700), ("b", 311), ("c", 1)):
        x = np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n).round(1))
        y = np.where(rng.random(n) < 0.4, x, rng.integers(0, 30, n))
        frames.append(pd.DataFrame({"k": key, "i": range(n), "x": x, "y": y}))
    frame = pd.concat(frames, ignore_index=True)
    frame.loc[frame.index % 17 == 0, "y"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).cache()
    return rows, frame


def test_ranks(table):
    rows, frame = table
    outs = {"average": "average", "lowest": "min", "down": "descending", "pct": "pct"}
    got = O.with_ranks(rows, ["k"], "x", outs).toPandas().sort_values(["k", "i"])
    by = frame.groupby("k").x
    assert np.allclose(got.average, by.rank())
    assert np.allclose(got.lowest, by.rank(method="min"))
    assert np.allclose(got.down, by.rank(ascending=False))
    assert np.allclose(got.pct, by.rank(pct=True) * 100)


def test_quantiles_skip_null(table):
    rows, frame = table
    got = O.quantiles(rows, ["k"], "y", {"q": 0.25, "m": 0.5, "h": 0.99}).toPandas().set_index("k")
    for key, group in frame.groupby("k"):
        values = group.y.dropna()
        if len(values):
            assert np.allclose(got.loc[key], np.percentile(values, [25, 50, 99]))


@pytest.mark.parametrize("bits", [3, 16])
def test_running_totals(spark, bits):
    rows = spark.createDataFrame([("a", int(c), float(c % 7)) for c in range(0, 300, 3)], "k string, code long, v double")
    got = O.running_totals(rows, ["k"], "code", ["v"], bits).toPandas().sort_values("code")
    assert np.allclose(got.v_before, got.v.cumsum() - got.v)
    assert np.allclose(got.v_all, got.v.sum())


def brute_tau(x, y):
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())


def brute_dcor(x, y):
    centre = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    a, b = centre(abs(x[:, None] - x)), centre(abs(y[:, None] - y))
    return np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))


def test_pair_statistics(table):
    rows, frame = table
    tau = S.kendall_tau_b(rows, ["k"]).toPandas().set_index("k").tau
    dcor = S.distance_correlation(rows, ["k"]).toPandas().set_index("k").r
    for key in "ab":
        group = frame[frame.k == key].dropna()
        x, y = group.x.values, group.y.values
        assert tau[key] == pytest.approx(brute_tau(x, y), abs=1e-12)
        assert dcor[key] == pytest.approx(brute_dcor(x, y), abs=1e-9)


def test_zero_variance_is_null(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert rows.agg(S.pearson("x", "y")).first()[0] is None


def test_partial_keeps_first_region(spark):
    """The lowest region keeps its values; other regions lose their mean."""
    rng = np.random.default_rng(0)
    regions = [1] * 5 + [2] * 6 + [None] * 2
    rows = [(f"u{i}", r, c, float(v)) for i, r in enumerate(regions) for c, v in (("p", rng.normal()), ("q", rng.normal()))]
    long = spark.createDataFrame([("s", *r) for r in rows], "scenario string, fips string, region int, component string, value double")
    got = S.partial_pairs(long, ["scenario"], "fips", "region", ["p", "q"]).first().r
    wide = long.toPandas().dropna().pivot(index=["fips", "region"], columns="component", values="value").reset_index()
    for c in "pq":
        means = wide.groupby("region")[c].transform("mean")
        wide[c] = np.where(wide.region == 1, wide[c], wide[c] - means)
    assert got == pytest.approx(np.corrcoef(wide.p, wide.q)[0, 1])


def test_ranks_of_a_hot_value(spark):
    """Nine of ten rows share one value; they are ranked without meeting in one task."""
    n = 20_000
    x = np.where(np.arange(n) % 10 == 0, np.arange(n) % 977, 0.0)
    frame = pd.DataFrame({"k": "a", "i": range(n), "x": x})
    rows = spark.createDataFrame(frame).repartition(8)
    ranked = O.with_ranks(rows, ["k"], "x", {"average": "average", "down": "descending"})
    got = ranked.toPandas().sort_values("i")
    assert len(got) == n and np.allclose(got.average, frame.x.rank()) and np.allclose(got.down, frame.x.rank(ascending=False))
    tasks = ranked.groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
    assert tasks.max() <= 2 * max(tasks.median(), n / 8)


def test_ranks_with_null_and_signed_zero(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", -0.0), ("a", None), ("a", 3.0), ("b", 1.0)], "k string, x double")
    got = O.with_ranks(rows, ["k"], "x", {"r": "average"}).collect()
    assert sorted((r.k, r.r) for r in got) == [("a", 1.5), ("a", 1.5), ("a", 3.0), ("b", 1.0)]
    assert O.with_ranks(rows.limit(0), ["k"], "x", {"r": "min"}).count() == 0


def test_ranks_do_not_depend_on_the_order_rows_arrive_in(spark):
    """F1, F2, F3, F4, F5, F6, F8, F10: bounds computed twice were not the same when rows came in another order."""
    size = 1_000_003

    def in_any_order(batches):
        rows = pd.concat(batches)
        yield rows.sample(frac=1, random_state=int.from_bytes(os.urandom(4)))

    rows = spark.range(size).select(F.lit("a").alias("k"), (F.col("id") * 7919 % size).cast("double").alias("x"))
    moved = rows.mapInPandas(in_any_order, rows.schema)
    reuse = "spark.sql.exchange.reuse"
    before = spark.conf.get(reuse)
    # As in a cluster, where a shuffle read twice brings its rows in two orders.
    spark.conf.set(reuse, "false")
    try:
        ranked = O.with_rank(moved, ["k"], "x", "place", "min")
        off = ~F.col("place").eqNullSafe(F.col("x") + 1)
        assert tuple(ranked.agg(F.count_if(off), F.count(F.lit(1))).first()) == (0, size)
        assert O.quantiles(moved, ["k"], "x", {"m": 0.5}).first()["m"] == (size - 1) / 2
    finally:
        spark.conf.set(reuse, before)
