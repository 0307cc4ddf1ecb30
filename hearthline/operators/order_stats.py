"""Exact ranks and quantiles without sorting a whole group in one task.

A global ``rank()`` or exact ``percentile`` puts a complete group (a component,
a scenario) on one executor.  Here a group is first reduced to a histogram of
its distinct values, which also removes hot values; the histogram is cut into
value ranges by approximate quantiles, each range is counted on its own, and
the small table of range totals is summed up in order.  The approximate cut
points only balance the work, the counts are exact.  That holds only if rows
and totals are cut at the same points, and approximate quantiles depend on the
order in which their rows arrive, so histogram and cut points are stored.

There is one form for every size: no row count chooses another plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.storage import materialize

_STEPS = (128, 64, 32, 16, 8, 4, 2, 1)
_FRACTIONS = [i / 256 for i in range(1, 256)]
#: A value held by more than this part of its group's rows is hot.
HOT_SHARE = 256


def _range_of(bounds: Column, value: Column) -> Column:
    """Number of sorted cut points below the value, by bisection."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in _STEPS]),
        F.lit(0),
        lambda found, step: F.when(F.get(bounds, found + step - 1) < value, found + step).otherwise(found),
    )


def ordered_histogram(
    df: DataFrame, keys: list[str], value: str, sums: bool = False
) -> DataFrame:
    """One row per distinct value of each group.

    Columns: keys, ``value``, ``n`` (rows with it), ``before`` (rows with less),
    ``total`` (rows of the group); with ``sums`` also ``sum_before`` and
    ``sum_total`` of the values.  NULL values are left out.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    hist = materialize(hist, "histogram")
    measures = {"before": F.col("n")}
    if sums:
        measures["sum_before"] = F.col("n") * F.col(value)
    bounds = hist.groupBy(*keys).agg(F.percentile_approx(value, _FRACTIONS, 2560).alias("_bounds"))
    placed = hist.join(materialize(bounds, "bounds"), keys).withColumn("_range", _range_of(F.col("_bounds"), F.col(value))).drop("_bounds")

    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(m).alias(f"_{name}") for name, m in measures.items()])
    in_order = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_{m}").over(in_order), F.lit(0)).alias(f"_off_{m}") for m in measures],
        F.sum("_before").over(whole).alias("total"),
        *([F.sum("_sum_before").over(whole).alias("sum_total")] if sums else []),
    )
    within = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        *keys,
        value,
        "n",
        "_range",
        *[F.coalesce(F.sum(m).over(within), F.lit(0)).alias(f"_loc_{name}") for name, m in measures.items()],
    )
    return local.join(offsets, [*keys, "_range"]).select(
        *keys,
        value,
        "n",
        *[(F.col(f"_loc_{m}") + F.col(f"_off_{m}")).alias(m) for m in measures],
        "total",
        *(["sum_total"] if sums else []),
    )


def average_rank(before: Column, n: Column) -> Column:
    """Rank with ties sharing their mean position."""
    return before + (n + 1) / 2.0


def with_ranks(
    df: DataFrame, keys: list[str], value: str, outs: dict[str, str]
) -> DataFrame:
    """Rows with a non-NULL value plus ranks within the group: output name -> method.

    Methods: ``average`` and ``min`` (ascending), ``descending`` (average, largest
    first), ``pct`` (average rank as a percentage of the group).
    """
    before, n, total = F.col("before"), F.col("n"), F.col("total")
    average = average_rank(before, n)
    methods = {
        "average": average,
        "min": before + 1,
        "descending": total + 1 - average,
        "pct": average / total * 100.0,
    }
    ranks = F.struct(*[methods[method].alias(out) for out, method in outs.items()])
    table = ordered_histogram(df, keys, value).select(*keys, value, "n", "total", ranks.alias("_ranks"))
    # A group has fewer than HOT_SHARE values this frequent; their rows take the ranks from one row of the group.
    entry = F.struct(value, "_ranks")
    hot = table.where(F.col("n") * HOT_SHARE > F.col("total")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_hot")
    )
    known = df.where(F.col(value).isNotNull()).join(hot, keys, "left").withColumn("_of_hot", F.try_element_at("_hot", F.col(value)))
    # Only rarer values meet the histogram; rows that need no match are spread by their content.
    content = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    is_hot = F.col("_of_hot").isNotNull()
    asked = known.withColumns({
        "_at": F.when(~is_hot, F.col(value)),
        "_spread": F.when(is_hot, F.xxhash64(*content)).otherwise(F.lit(0).cast("long")),
    }).drop("_hot")
    rare = table.where(F.col("n") * HOT_SHARE <= F.col("total")).select(
        *keys, F.col(value).alias("_at"), F.lit(0).cast("long").alias("_spread"), "_ranks"
    )
    found = asked.join(rare, [*keys, "_at", "_spread"], "left").withColumn("_ranks", F.coalesce("_of_hot", "_ranks"))
    return found.select(*df.columns, *[F.col(f"_ranks.{out}").alias(out) for out in outs])


def with_rank(
    df: DataFrame, keys: list[str], value: str, out: str, method: str = "average"
) -> DataFrame:
    """``with_ranks`` for a single rank column."""
    return with_ranks(df, keys, value, {out: method})


def quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per name."""
    hist = ordered_histogram(df, keys, value)

    def at(position: Column) -> Column:
        inside = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    parts, results = [], []
    for name, p in probabilities.items():
        exact = (F.col("total") - 1) * F.lit(float(p))
        parts += [at(F.floor(exact)).alias(f"_lo_{name}"), at(F.ceil(exact)).alias(f"_hi_{name}")]
        share = (F.col("_total") - 1) * F.lit(float(p)) % 1.0
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append((low + (high - low) * share).alias(name))
    return hist.groupBy(*keys).agg(F.max("total").alias("_total"), *parts).select(*keys, *results)


def running_totals(
    df: DataFrame, keys: list[str], code: str, measures: list[str], chunk_bits: int = 16
) -> DataFrame:
    """Sums over rows with a smaller integer ``code``, plus group totals.

    Codes must be distinct within a group.  Chunks of ``2**chunk_bits`` codes
    are summed on their own and the chunk totals in order, so no group is
    sorted as a whole.  Adds ``<m>_before`` and ``<m>_all`` per measure.
    """
    chunked = df.withColumn("_chunk", F.shiftright(F.col(code), chunk_bits))
    totals = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(m).alias(m) for m in measures])
    in_order = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(m).over(in_order), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_all") for m in measures],
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(code).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked
    for m in measures:
        local = local.withColumn(f"_loc_{m}", F.coalesce(F.sum(m).over(within), F.lit(0)))
    joined = local.join(offsets, [*keys, "_chunk"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_loc_{m}") + F.col(f"_off_{m}")).alias(f"{m}_before") for m in measures],
        *[F.col(f"{m}_all") for m in measures],
    )
