"""Queries whose keys have more digits than the tables of the other tests hold, against their SQL."""

import os

import pytest

import oracle
from hearthline.bindings import catalog

SOURCE = "/root/testdata/sf0.001"
SHIFTS = {
    "customer": {"c_custkey": 100_000},
    "supplier": {"s_suppkey": 1_000},
    "orders": {"o_orderkey": 120_000, "o_custkey": 100_000},
    "lineitem": {"l_orderkey": 120_000, "l_suppkey": 1_000},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables twice, the second time with larger keys."""
    duck = oracle.connect(SOURCE)
    to = tmp_path_factory.mktemp("long")
    for name in oracle.TABLES:
        keys = ", ".join(f"{k} + i * {by} AS {k}" for k, by in SHIFTS.get(name, {}).items())
        rows = f"SELECT * EXCLUDE (i) REPLACE ({keys}) FROM {name}, (VALUES (0), (1)) AS copies(i)" if keys else f"FROM {name}"
        duck.execute(f"COPY ({rows}) TO '{to}/{name}.parquet' (FORMAT parquet)")
    return str(to)


def check(spark, folder, name):
    function, sql = catalog()[name]
    text, good = oracle.compare(spark, oracle.connect(folder), folder, function, sql)
    assert good, text


@pytest.mark.skipif(not os.path.isdir(SOURCE), reason="test tables are absent")
def test_zones_with_six_digits_are_not_those_with_five(spark, folder):
    """F9"""
    check(spark, folder, "storm_events_clean")


@pytest.mark.skipif(not os.path.isdir(SOURCE), reason="test tables are absent")
def test_population_is_that_of_five_digit_counties(spark, folder):
    """F7"""
    check(spark, folder, "prepare_population")


@pytest.mark.skipif(not os.path.isdir(SOURCE), reason="test tables are absent")
def test_drought_records_keep_longer_county_numbers(spark, folder):
    """F12"""
    check(spark, folder, "scan_json_records")


@pytest.mark.skipif(not os.path.isdir(SOURCE), reason="test tables are absent")
def test_visits_keep_longer_county_numbers(spark, folder):
    """F11"""
    check(spark, folder, "scan_health_json")
