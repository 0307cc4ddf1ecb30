"""Ordered operators: trends, fills, ranks within small groups.

Windows here run over groups with a natural bound (the days or years of a
county, the twelve components); rows are reduced to that grain first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import columns as C
from hearthline.operators.order_stats import quantiles
from hearthline.storage import materialize


def rolling_median_baseline(daily: DataFrame, value: str = "daily_pm25", rows: int = P.SMOKE_WINDOW_ROWS) -> DataFrame:
    """Median of the last ``rows`` daily rows of the county, this one included."""
    frame = Window.partitionBy("fips").orderBy("date").rowsBetween(-(rows - 1), 0)
    return daily.withColumn("pm25_baseline", F.percentile(value, F.lit(0.5)).over(frame))


def is_spike(value: str = "daily_pm25") -> Column:
    return F.coalesce(F.col(value) > P.SMOKE_MULTIPLIER * F.col("pm25_baseline"), F.lit(False))


def spike_days(daily: DataFrame) -> DataFrame:
    """Days whose concentration is well above the rolling baseline."""
    return rolling_median_baseline(daily).where(is_spike()).select(
        "fips", "date", "year", F.lit("spike_detection").alias("method")
    )


def smoke_by_year(smoke: DataFrame, daily: DataFrame, default_method: str) -> DataFrame:
    """Smoke days of every county-year with readings, zero included."""
    from hearthline.operators.rollups import method_majority

    return (
        daily.select("fips", "year")
        .distinct()
        .join(method_majority(smoke), ["fips", "year"], "left")
        .select(
            "fips",
            "year",
            F.coalesce("smoke_days", F.lit(0)).alias("smoke_days"),
            F.coalesce("smoke_day_method", F.lit(default_method)).alias("smoke_day_method"),
        )
    )


def covered_smoke_days(daily: DataFrame, plume_dates: DataFrame, plume_hits: DataFrame) -> DataFrame:
    """Smoke days with plume data: on covered dates a plume must also touch the county.

    ``plume_dates`` has the covered ``date`` values, ``plume_hits`` the touched
    ``(fips, date)`` pairs.  The baseline is computed before dates are split.
    """
    spikes = rolling_median_baseline(daily).where(is_spike())
    covered = plume_dates.select("date").distinct().withColumn("_covered", F.lit(True))
    hit = plume_hits.select("fips", "date").distinct().withColumn("_hit", F.lit(True))
    marked = spikes.join(covered, "date", "left").join(hit, ["fips", "date"], "left")
    return marked.where(F.col("_covered").isNull() | F.col("_hit").isNotNull()).select(
        "fips",
        "date",
        "year",
        F.when(F.col("_covered"), F.lit("hms")).otherwise(F.lit("spike_detection")).alias("method"),
    )


def yoy_change(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Percent change against the previous available year."""
    previous = F.lag(value).over(Window.partitionBy(*group).orderBy("year"))
    return df.withColumn("_prev", previous).withColumn(
        out, F.try_divide(F.col(value) - F.col("_prev"), F.col("_prev")) * 100.0
    ).drop("_prev")


def structural_breaks(df: DataFrame, group: str, value: str, threshold: float = P.PRICE_BREAK) -> DataFrame:
    """Rows with ``is_break``: relative change to the previous year beyond the threshold."""
    previous = F.lag(value).over(Window.partitionBy(group).orderBy("year"))
    change = F.try_divide(F.col(value), previous) - 1.0
    return df.withColumn("is_break", F.coalesce(F.abs(change) > threshold, F.lit(False)))


def fill_within(df: DataFrame, group: str, value: str) -> DataFrame:
    """Missing values from the previous year of the group, else from the next."""
    ordered = Window.partitionBy(group).orderBy("year")
    back = F.last(value, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumns({"_back": back, "_ahead": ahead}).withColumn(
        value, F.coalesce("_back", "_ahead")
    ).drop("_back", "_ahead")


def carry_forward_latest(
    panel: DataFrame, value: str, target_year: int, auxiliary: list[str], confidence: str | None = None
) -> DataFrame:
    """Missing values of the target year from the unit's most recent other value.

    "Most recent" is the latest year with a value, even one after the target.
    """
    taken = F.struct(value, *auxiliary)
    latest = (
        panel.where(F.col(value).isNotNull())
        .groupBy("fips")
        .agg(F.max_by(taken, "year").alias("_latest"))
    )
    joined = panel.join(latest, "fips", "left")
    needs = (F.col("year") == target_year) & F.col(value).isNull() & F.col("_latest").isNotNull()
    filled = {c: F.when(needs, F.col(f"_latest.{c}")).otherwise(F.col(c)) for c in [value, *auxiliary]}
    if confidence:
        filled[confidence] = F.when(needs, F.lit("C")).otherwise(F.col(confidence))
    return joined.withColumns(filled).select(*panel.columns)


def theil_sen(
    panel_long: DataFrame, registry: DataFrame, scoring_year: int, keys: list[str], min_completeness: float = 0.8
) -> DataFrame:
    """Median pairwise slope of each component and unit in its trailing window.

    ``panel_long`` has keys (ending in ``fips``), ``year``, ``component``,
    ``value``; ``registry`` gives the ``window`` per component and any scenario
    columns among the keys.  Units with too few years get NULL; a component with
    fewer than two years anywhere gets 0 for every unit.
    """
    return window_slopes(panel_long, registry, scoring_year, keys, min_completeness).drop("window")


def window_slopes(
    panel_long: DataFrame, registry: DataFrame, scoring_year: int, keys: list[str], min_completeness: float = 0.8
) -> DataFrame:
    """``theil_sen`` where ``registry`` may give a component several windows: adds ``window``.

    The points of a unit are gathered once and cut to each window there.
    """
    scenario = [k for k in keys if k != "fips"]
    given = [*[c for c in registry.columns if c in scenario], "component"]
    spans = registry.groupBy(*given).agg(F.collect_set("window").alias("_windows"))
    windowed = panel_long.where(F.col("value").isNotNull()).join(spans, given).where(
        F.col("year").between(scoring_year - F.array_max("_windows") + 1, scoring_year)
    )
    inside = lambda year: year > scoring_year - F.col("window")
    # A unit has at most ``window`` points per component, so the list is short.
    point = F.struct(F.col("year").cast("double").alias("t"), F.col("value").alias("v"))
    grouped = (
        windowed.groupBy(*keys, "component")
        .agg(F.sort_array(F.collect_list(point)).alias("_all"), F.first("_windows").alias("_windows"))
        .withColumn("window", F.explode("_windows"))
        .withColumn("_points", F.filter("_all", lambda p: inside(p["t"])))
        .where(F.size("_points") > 0)
    )
    points = F.col("_points")
    slopes = F.flatten(
        F.transform(
            points,
            lambda p: F.transform(
                F.filter(points, lambda q: q["t"] > p["t"]), lambda q: (q["v"] - p["v"]) / (q["t"] - p["t"])
            ),
        )
    )
    ordered = F.sort_array(slopes)
    size = F.size("_slopes")
    middle = (
        F.get("_slopes", F.floor((size - 1) / 2).cast("int")) + F.get("_slopes", F.floor(size / 2).cast("int"))
    ) / 2.0
    enough = F.greatest(F.lit(2), F.ceil(F.col("window") * min_completeness))
    # One row per year of a component before its windows are counted.
    seen = windowed.groupBy(*scenario, "component", "year").agg(F.first("_windows").alias("_windows"))
    years = seen.withColumn("window", F.explode("_windows")).where(inside(F.col("year"))).groupBy(
        *scenario, "component", "window"
    ).agg(F.count(F.lit(1)).alias("_years"))
    return (
        grouped.withColumn("_slopes", ordered)
        .withColumn("slope", F.when((F.size("_points") >= enough) & (size > 0), middle))
        .join(years, [*scenario, "component", "window"])
        .select(*keys, "component", "window", F.when(F.col("_years") < 2, F.lit(0.0)).otherwise(F.col("slope")).alias("slope"))
    )


def acceleration_multipliers(
    slopes: DataFrame, scenario: list[str], low: float, high: float, epsilon: float
) -> DataFrame:
    """Multiplier of each slope relative to the component's median slope.

    A flat component (no or zero deviation) has multiplier 1 everywhere; a
    median near zero switches from the ratio to the difference form.
    """
    group = [*scenario, "component"]
    # Read for the deviation, the median and the result.
    slopes = materialize(slopes, "slopes")
    spread = slopes.groupBy(*group).agg(F.stddev_samp("slope").alias("sigma"))
    medians = quantiles(slopes, group, "slope", {"median": 0.5})
    joined = slopes.join(spread, group).join(medians, group, "left")
    slope, median, sigma = F.col("slope"), F.col("median"), F.col("sigma")
    ratio = F.try_divide(slope, median)
    difference = 1.0 + F.try_divide(slope - median, sigma)
    raw = F.when(F.abs(median) >= epsilon * sigma, ratio).otherwise(difference)
    moved = F.when(sigma > 0, F.coalesce(raw, F.lit(1.0))).otherwise(F.lit(1.0))
    return joined.select(
        *[c for c in slopes.columns if c != "slope"],
        "slope",
        F.least(F.lit(high), F.greatest(F.lit(low), moved)).alias("acceleration"),
    )


def winsorize_upper(long: DataFrame, keys: list[str], percentile: float) -> DataFrame:
    """Values above the group's percentile lowered to it."""
    cut = quantiles(long, keys, "value", {"_cut": percentile / 100.0})
    return long.join(cut, keys).withColumn("value", C.clamp_high(F.col("value"), F.col("_cut"))).drop("_cut")


def zscore_normalize(long: DataFrame, keys: list[str]) -> DataFrame:
    """Sample z-scores per group; a flat group scores zero, a single value stays."""
    stats = long.groupBy(*keys).agg(
        F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"), F.count("value").alias("_n")
    )
    scaled = (
        F.when(F.col("_n") < 2, F.col("value"))
        .when(F.col("_std") < 1e-10, F.when(F.col("value").isNotNull(), F.lit(0.0)))
        .otherwise(F.try_divide(F.col("value") - F.col("_mean"), F.col("_std")))
    )
    return long.join(stats, keys).withColumn("value", scaled).drop("_mean", "_std", "_n")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of an order; Spark keeps only ``k`` rows per task."""
    return df.orderBy(*order).limit(k)


def recent_years(df: DataFrame, count: int) -> DataFrame:
    """Rows of the last ``count`` years that occur."""
    years = df.select("year").distinct().orderBy(F.col("year").desc()).limit(count)
    return df.join(years, "year", "left_semi")


def score_bands(scores: DataFrame, score: str, years: int = 5) -> DataFrame:
    """Modal ten-point band of each unit over recent years and its stability class."""
    band = (F.floor(F.col(score) / 10) * 10).cast("int")
    banded = recent_years(scores, years).withColumn("_band", band)
    # At most one row per band and unit; ties go to the lowest band.
    counts = banded.groupBy("fips", "_band").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("fips").agg(
        F.max_by("_band", F.struct(F.col("_n"), -F.col("_band"))).alias("modal_band"),
        F.max("_n").alias("years_in_modal_band"),
        C.stability_class(F.max("_n"), F.count(F.lit(1))).alias("stability_class"),
    )


def argmax_driver(wide: DataFrame, components: list[str]) -> Column:
    """Component with the largest absolute score; the first listed wins ties."""
    entries = F.array(
        *[F.struct(F.abs(F.col(c)).alias("size"), F.lit(-i).alias("order"), F.lit(c).alias("name"))
          for i, c in enumerate(components)]
    )
    present = F.filter(entries, lambda e: e["size"].isNotNull())
    return F.array_max(present)["name"]
