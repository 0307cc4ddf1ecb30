"""What the operators of this folder share: reading tables, stored steps, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.storage import discard, materialize, scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exact_sum(column) -> F.Column:
    """Sum of a long column that cannot overflow."""
    return F.sum(column.cast("decimal(20,0)"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(node, root)``, root the smallest node, roots left out.

    Large-star and small-star steps alternate until every node has one link, to a node that has none.  Each step is a
    grouped minimum and a join on the node, so a node with very many links is pre-aggregated on one side and split by
    adaptive execution on the other.  Each round is written to the shared folder in place of the one before; only one
    row of counts per round reaches the driver.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links", path := scratch_path(spark, "links"))
    while not _flat(edges):
        old, path = path, scratch_path(spark, "links")
        edges = materialize(_small_star(_large_star(edges)), "links", path)
        discard(spark, old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _flat(edges: DataFrame) -> bool:
    """Whether every ``a`` has one link only and is no other node's ``b``; then all links are those of components."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return not counted.where("up > 1 or up = 1 and n > 1").agg(F.count("*")).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    linked = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.union(low.select("a", F.col("low").alias("b"))).distinct()
