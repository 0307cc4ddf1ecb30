"""Correlation statistics as grouped DataFrame jobs.

Rank-pair statistics (Kendall, distance correlation) are defined over all pairs
of rows.  They are computed here in n log n rows: the x order is split by the
bits of its position, so that every ordered pair meets in exactly one block,
and inside a block running sums along y replace the pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.order_stats import ordered_histogram, running_totals, with_rank
from hearthline.storage import materialize


def pearson(x: str, y: str) -> Column:
    """Pearson correlation over pairwise complete rows; NULL for zero variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def pair_rows(wide: DataFrame, keys: list[str], components: list[str], only: str | None = None) -> DataFrame:
    """Every component pair of a row, or those with the component ``only``: keys, ``a``, ``b``, ``x``, ``y``.

    The fan-out is the fixed number of component pairs per row.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
            for a, b in combinations(components, 2)
            if only is None or only in (a, b)
        ]
    )
    return wide.select(*keys, F.inline(pairs))


def pearson_pairs(wide: DataFrame, keys: list[str], components: list[str], only: str | None = None) -> DataFrame:
    """Pearson correlation of each component pair (or of those with ``only``): keys, ``a``, ``b``, ``r``, ``n``."""
    rows = pair_rows(wide, keys, components, only)
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return rows.groupBy(*keys, "a", "b").agg(pearson("x", "y").alias("r"), F.count_if(both).alias("n"))


def full_matrix(pairs: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Wide symmetric matrix with a unit diagonal, one row per component."""
    mirrored = pairs.select(*keys, "a", "b", "r").unionByName(
        pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "r")
    )
    diagonal = pairs.select(*keys, F.explode(F.array("a", "b")).alias("a")).distinct()
    everything = mirrored.unionByName(diagonal.select(*keys, "a", F.col("a").alias("b"), F.lit(1.0).alias("r")))
    return (
        everything.groupBy(*keys, F.col("a").alias("component"))
        .pivot("b", list(components))
        .agg(F.first("r", ignorenulls=True))
    )


def spearman(
    df: DataFrame, keys: list[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Rank correlation of two columns per group, ranked on complete rows: ``r``, ``n``."""
    complete = df.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    complete = materialize(complete, "ranked")
    ranked = with_rank(with_rank(complete, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(pearson("_rx", "_ry").alias("r"), F.count(F.lit(1)).alias("n"))


def pearson_and_spearman(
    df: DataFrame, keys: list[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Both correlations over complete rows: ``pearson_r``, ``spearman_r``, ``n``."""
    complete = df.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    complete = materialize(complete, "ranked")
    ranked = with_rank(with_rank(complete, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(
        pearson(x, y).alias("pearson_r"), pearson("_rx", "_ry").alias("spearman_r"), F.count(F.lit(1)).alias("n")
    )


def _blocks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells copied to each bit level of ``xcode``: adds ``level``, ``prefix``, ``side``."""
    bits = F.greatest(F.ceil(F.log2(F.col("total").cast("double"))).cast("int"), F.lit(1))
    return cells.withColumn("level", F.explode(F.sequence(F.lit(0), bits - 1))).select(
        "*",
        F.expr("shiftright(xcode, level + 1)").alias("prefix"),
        F.expr("shiftright(xcode, level) & 1").alias("side"),
    )


def _row_distance_sum(value: str) -> Column:
    """Sum of |value - other| over the group, from histogram columns."""
    v, n = F.col(value), F.col("n")
    below = v * F.col("before") - F.col("sum_before")
    above = F.col("sum_total") - F.col("sum_before") - n * v - v * (F.col("total") - F.col("before") - n)
    return below + above


def _coded(
    df: DataFrame, keys: list[str], x: str, y: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct (x, y) cells, stored, and both histograms.

    A cell has its count ``n``, order codes ``xcode`` and ``ycode``, the group
    ``total``, and the distance sums ``ax`` and ``by`` of its values.
    """
    complete = df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).where(
        F.col(x).isNotNull() & F.col(y).isNotNull()
    )
    complete = materialize(complete, "complete")
    hist_x = ordered_histogram(complete, keys, "x", sums=True)
    hist_y = ordered_histogram(complete, keys, "y", sums=True)
    of_x = hist_x.select(*keys, "x", F.col("before").alias("xcode"), "total", _row_distance_sum("x").alias("ax"))
    of_y = hist_y.select(*keys, "y", F.col("before").alias("ycode"), _row_distance_sum("y").alias("by"))
    cells = complete.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n")).join(of_x, [*keys, "x"]).join(of_y, [*keys, "y"])
    return materialize(cells, "cells"), hist_x, hist_y


def kendall_tau_b(
    df: DataFrame, keys: list[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Kendall's tau-b per group: keys, ``tau``."""
    cells, hist_x, hist_y = _coded(df, keys, x, y)
    block = [*keys, "level", "prefix"]
    columns = _blocks(cells, keys).groupBy(*block, "ycode").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("lower"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("upper"),
    )
    summed = running_totals(columns, block, "ycode", ["lower"])
    above = F.col("lower_all") - F.col("lower_before") - F.col("lower")
    balance = summed.groupBy(*keys).agg(
        F.sum(F.col("upper").cast("double") * (F.col("lower_before") - above)).alias("balance")
    )
    untied = lambda hist, name: hist.groupBy(*keys).agg(
        (
            F.max(F.col("total").cast("double") * (F.col("total") - 1)) / 2
            - F.sum(F.col("n").cast("double") * (F.col("n") - 1)) / 2
        ).alias(name)
    )
    return (
        untied(hist_x, "px")
        .join(untied(hist_y, "py"), keys)
        .join(balance, keys, "left")
        .select(*keys, F.try_divide(F.coalesce("balance", F.lit(0.0)), F.sqrt(F.col("px")) * F.sqrt(F.col("py"))).alias("tau"))
    )


def distance_correlation(
    df: DataFrame, keys: list[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Biased (V-statistic) distance correlation per group: keys, ``r``."""
    cells, _, _ = _coded(df, keys, x, y)
    block = [*keys, "level", "prefix"]
    lower = lambda c: F.sum(F.when(F.col("side") == 0, c).otherwise(0))
    upper = lambda c: F.sum(F.when(F.col("side") == 1, c).otherwise(0))
    n, nx = F.col("n"), F.col("n") * F.col("x")
    columns = _blocks(cells, keys).groupBy(*block, "ycode", "y").agg(
        lower(n).alias("ln"), lower(nx).alias("lx"), upper(n).alias("un"), upper(nx).alias("ux")
    )
    columns = columns.withColumns({"ly": F.col("ln") * F.col("y"), "lxy": F.col("lx") * F.col("y")})
    summed = running_totals(columns, block, "ycode", ["ln", "lx", "ly", "lxy"])
    concordant = summed.groupBy(*keys).agg(
        F.sum(
            F.col("ux") * F.col("y") * F.col("ln_before")
            - F.col("ux") * F.col("ly_before")
            - F.col("un") * F.col("y") * F.col("lx_before")
            + F.col("un") * F.col("lxy_before")
        ).alias("concordant")
    )
    w = F.col("n")
    size = F.sum(w).cast("double")
    mean = lambda c: F.sum(w * c) / size
    moments = cells.groupBy(*keys).agg(
        size.alias("size"),
        (mean(F.col("x") * F.col("y")) - mean(F.col("x")) * mean(F.col("y"))).alias("cov"),
        (mean(F.col("x") * F.col("x")) - mean(F.col("x")) * mean(F.col("x"))).alias("vx"),
        (mean(F.col("y") * F.col("y")) - mean(F.col("y")) * mean(F.col("y"))).alias("vy"),
        (mean(F.col("ax")) / size).alias("ma"),
        (mean(F.col("by")) / size).alias("mb"),
        (mean(F.col("ax") * F.col("by")) / (size * size)).alias("mab"),
        (mean(F.col("ax") * F.col("ax")) / (size * size)).alias("maa"),
        (mean(F.col("by") * F.col("by")) / (size * size)).alias("mbb"),
    )
    both = moments.join(concordant, keys, "left")
    pairs = 2.0 * (2.0 * F.coalesce("concordant", F.lit(0.0)) / (F.col("size") * F.col("size")) - F.col("cov"))
    dcov = pairs + F.col("ma") * F.col("mb") - 2.0 * F.col("mab")
    dvar_x = 2.0 * F.col("vx") + F.col("ma") * F.col("ma") - 2.0 * F.col("maa")
    dvar_y = 2.0 * F.col("vy") + F.col("mb") * F.col("mb") - 2.0 * F.col("mbb")
    scale = F.sqrt(F.greatest(dvar_x, F.lit(0.0))) * F.sqrt(F.greatest(dvar_y, F.lit(0.0)))
    ratio = F.coalesce(F.try_divide(F.greatest(dcov, F.lit(0.0)), scale), F.lit(0.0))
    return both.select(*keys, F.sqrt(ratio).alias("r"))


def partial_pairs(long: DataFrame, keys: list[str], row: str, region: str, components: list[str]) -> DataFrame:
    """Pearson of values with region means removed: keys, ``a``, ``b``, ``r``, ``n``.

    The lowest region present is the reference level and keeps its own values;
    rows without a region are left out; fewer than three of them give no result,
    and a component with fewer than three values gives NULL.
    """
    known = long.where(F.col(region).isNotNull() & F.col("value").isNotNull())
    means = known.groupBy(*keys, "component", region).agg(F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    counts = means.groupBy(*keys, "component").agg(F.sum("_n").alias("_values"))
    lowest = long.where(F.col(region).isNotNull()).groupBy(*keys).agg(
        F.min(region).alias("_base"), F.count_distinct(row).alias("_rows")
    )
    residual = (
        known.join(means, [*keys, "component", region])
        .join(counts, [*keys, "component"])
        .join(lowest.where(F.col("_rows") >= 3), keys)
        .where(F.col("_values") >= 3)
        .withColumn("_res", F.when(F.col(region) == F.col("_base"), F.col("value")).otherwise(F.col("value") - F.col("_mean")))
    )
    wide = residual.groupBy(*keys, row).pivot("component", list(components)).agg(F.first("_res"))
    return pearson_pairs(wide, keys, components)
