"""Checks that return tables instead of log lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthline import params as P


def validate_schema(df: DataFrame, expected: StructType) -> DataFrame:
    """The frame itself when its columns and types match exactly, else an error."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    problems = [f"missing {c}" for c in want if c not in have]
    problems += [f"unexpected {c}" for c in have if c not in want]
    problems += [f"{c} is {have[c]}, not {want[c]}" for c in want if c in have and have[c] != want[c]]
    if problems:
        raise ValueError("schema mismatch: " + "; ".join(problems))
    return df.select(*want)


def schema_report(df: DataFrame, expected: StructType) -> DataFrame:
    """The same comparison as rows ``(column, expected, actual, status)``."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}

    def status(name):
        if name not in have:
            return "missing"
        if name not in want:
            return "unexpected"
        return "ok" if have[name] == want[name] else "wrong_type"

    names = [*want, *[c for c in have if c not in want]]
    rows = [(c, want.get(c), have.get(c), status(c)) for c in names]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string, status string")


def completeness_report(
    df: DataFrame, unit: str, columns: list[str], expected_units: int = P.US_COUNTY_COUNT
) -> DataFrame:
    """Rows, units, unit coverage, and the filled share of each column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(unit).alias("n_units"),
        (F.count_distinct(unit) * 100.0 / expected_units).alias("unit_pct"),
        *[(F.avg(F.col(c).isNotNull().cast("double")) * 100.0).alias(f"{c}_pct") for c in columns],
    )


def anti_join_report(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Keys without a mapping and how many rows they hold."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(mapping.select(key), key, "left_anti")


def extreme_value_report(events: DataFrame, threshold: float = P.EXTREME_DAMAGE) -> DataFrame:
    """Events with more damage than is believable."""
    return events.where(F.col("total_damage") > threshold)


def classification_summary(events: DataFrame) -> DataFrame:
    """Events per tier; tier NULL holds the unreported and unknown ones."""
    return events.groupBy("severity_tier").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("total_damage") == 0).alias("n_zero_damage"),
        F.count_if(F.col("total_damage").isNull()).alias("n_null_damage"),
    )


def reconcile_outputs(
    left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6
) -> DataFrame:
    """Keys that one side lacks, or whose values differ by more than the tolerance."""
    a = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    b = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    joined = a.join(b, keys, "full_outer")
    differs = lambda c: ~(
        F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
        | F.coalesce(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) <= tolerance, F.lit(False))
    )
    state = (
        F.when(F.col("_in_a").isNull(), F.lit("only_right"))
        .when(F.col("_in_b").isNull(), F.lit("only_left"))
        .when(reduce(lambda p, q: p | q, [differs(c) for c in columns]), F.lit("differs"))
        .otherwise(F.lit("equal"))
    )
    return joined.select(*keys, state.alias("status")).where(F.col("status") != "equal")


def coverage_by_component(panel: DataFrame, components: list[str]) -> DataFrame:
    """Filled rows and share of each component: ``(component, n_present, pct_present)``."""
    counts = panel.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in components]
    )
    return counts.unpivot("_rows", components, "component", "n_present").select(
        "component", "n_present", F.try_divide(F.col("n_present") * 100.0, F.col("_rows")).alias("pct_present")
    )
