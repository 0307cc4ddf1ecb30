"""What stored steps leave on disk."""

import os
import time

from pyspark.sql import functions as F

from hearthline.llm.common import components
from hearthline.storage import CLEANUP_CONF, materialize, scratch_root


def shuffle_files(spark) -> set[str]:
    """Shuffle files of this session's block manager."""
    tops = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {name for top in tops for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def link_tables(spark) -> set[str]:
    """Stored rounds of components."""
    top = scratch_root(spark).removeprefix("file://") + "/hearthline"
    return {name for name in os.listdir(top) if name.startswith("links-")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP_CONF)
    rows = spark.range(2000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    stored = materialize(rows.join(spark.range(7), F.col("k") == F.col("id")).orderBy("k"), "counts")
    assert [(r.k, r.n) for r in stored.orderBy("k").collect()][:2] == [(0, 286), (1, 286)]
    # The same frame can be stored again: its shuffles are made anew.
    assert materialize(rows, "counts").count() == 7
    assert spark.conf.get(CLEANUP_CONF) == setting
    # Files go in the background; the collect and the count are no stored steps and keep a shuffle each.
    for _ in range(40):
        left = {name.split("_")[1] for name in shuffle_files(spark) - before}
        if len(left) <= 2:
            break
        time.sleep(0.25)
    assert len(left) <= 2


def test_rounds_of_components_replace_each_other(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    before = link_tables(spark)
    found = {(r.node, r.root) for r in components(chain).collect()}
    assert found == {(i, 0) for i in range(1, 41)} | {(101, 100)}
    assert len(link_tables(spark) - before) == 1


def test_components_stop_at_the_first_flat_round(spark, monkeypatch):
    from hearthline.llm import common

    rounds = []
    monkeypatch.setattr(common, "_small_star", lambda edges, f=common._small_star: rounds.append(1) or f(edges))
    star = spark.createDataFrame([(0, i) for i in range(1, 30)], "a long, b long")
    assert {(r.node, r.root) for r in components(star).collect()} == {(i, 0) for i in range(1, 30)}
    assert not rounds
    links = [(5, 9), (7, 9), (9, 9), (3, 7), (20, 21), (21, 22), (20, 22), (5, 9)]
    found = {(r.node, r.root) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {(5, 3), (7, 3), (9, 3), (21, 20), (22, 20)}


def test_new_links_join_components_by_their_roots(spark):
    from hearthline.llm import hamming

    steps = hamming.Steps(spark)
    roots = spark.createDataFrame([(2, 1), (3, 1), (11, 10), (31, 30)], "node long, root long")
    good = spark.createDataFrame([(3, 11), (11, 40), (50, 51), (2, 3)], "a long, b long")
    found = {(r.node, r.root) for r in hamming._linked(roots, good, "roots", steps).collect()}
    assert found == {(2, 1), (3, 1), (10, 1), (11, 1), (40, 1), (31, 30), (51, 50)}
