"""Writers of component tables, panels, score bundles and their metadata."""

from __future__ import annotations

import json
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import params as P

if TYPE_CHECKING:
    from hearthline.plans.index import IndexResult


def write_year_partitions(df: DataFrame, root: str, name: str) -> str:
    """Write one folder per year, replacing only the years present in ``df``.

    Rows of a year are spread over tasks by Spark's rebalance, so one heavy year
    becomes several files rather than one long task.
    """
    path = f"{root}/{name}"
    (
        df.hint("rebalance", "year")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )
    return path


def write_metadata(df: DataFrame, path: str, **facts) -> str:
    """Write a one-row JSON record of fixed facts and the creation time beside a table."""
    row = df.sparkSession.range(1).select(
        *[F.lit(v).alias(k) for k, v in facts.items()], F.current_timestamp().alias("retrieved_at")
    )
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_bundle(tables: dict[str, DataFrame], root: str, facts: DataFrame | None = None, **fixed) -> dict[str, str]:
    """Publish all tables of a result, with its facts, in one step.

    Each part goes to a folder of this run; the manifest row that names them is appended last, in one file.  Readers
    start from the manifest, so they see the whole former result or the whole new one, and a run that fails half-way
    leaves nothing they would read.  ``facts`` is a one-row table of values, ``fixed`` are constants.
    """
    run = uuid.uuid4().hex
    paths = {name: f"{root}/{run}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(paths[name])
    spark = next(iter(tables.values())).sparkSession
    row = facts if facts is not None else spark.range(1).drop("id")
    values = [F.col(c).cast("double").alias(c) for c in row.columns] + [F.lit(v).alias(k) for k, v in fixed.items()]
    row = row.select(
        F.lit(run).alias("run"), F.current_timestamp().alias("published_at"),
        F.array(*[F.lit(n) for n in sorted(tables)]).alias("parts"), F.to_json(F.struct(*values) if values else F.create_map()).alias("facts"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return paths


def read_bundle(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and facts of the result published last under ``root``."""
    last = spark.read.parquet(f"{root}/manifest").orderBy(F.desc("published_at"), "run").first()
    return {name: spark.read.parquet(f"{root}/{last['run']}/{name}") for name in last["parts"]}, json.loads(last["facts"])


def write_index(result: IndexResult, root: str) -> dict[str, str]:
    """Publish an index result: eight tables, and its scale, national value, universe and penalty counts as facts."""
    tables = {
        "scores": result.scores, "components": result.components, "accelerations": result.accelerations,
        "penalties": result.penalties, "correlation": result.correlation, "strain": result.strain,
        "dollar": result.dollar, "universe": result.universe,
    }
    counted = lambda df, name: df.groupBy("scenario").agg(F.count(F.lit(1)).alias(name))
    facts = (
        result.k.join(result.national, "scenario", "left")
        .join(counted(result.universe, "universe_size"), "scenario", "left")
        .join(counted(result.penalties, "n_penalties"), "scenario", "left")
        .fillna(0, ["universe_size", "n_penalties"])
    )
    return write_bundle(tables, root, facts.where(F.col("scenario") == "primary").drop("scenario"))


def panel_metadata(panel: DataFrame) -> DataFrame:
    """One row: rows, counties, year range, components included and empty."""
    present = [c for c in P.COMPONENT_IDS if c in panel.columns]
    absent = [c for c in P.COMPONENT_IDS if c not in panel.columns]
    named = lambda c, empty: F.when((F.count(c) == 0) if empty else F.lit(True), F.lit(c))
    listing = lambda empty: F.array_compact(F.array(*[named(c, empty) for c in present]))
    missing = F.concat(F.array(*[F.lit(c) for c in absent]).cast("array<string>"), listing(True))
    return panel.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("fips").alias("total_counties"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.array_join(listing(False), ",").alias("components_included"),
        F.array_join(missing, ",").alias("components_missing"),
    )


def write_panel(panel: DataFrame, root: str, scoring_year: int) -> str:
    """Write the harmonized panel by year, with its metadata record."""
    path = write_year_partitions(panel, root, f"panel_{scoring_year}")
    panel_metadata(panel).coalesce(1).write.mode("overwrite").json(f"{path}_metadata")
    return path
