"""A selection of registered queries against DuckDB on the smallest tables.

``python tests/oracle.py`` runs all of them on the larger ones.
"""

import os

import pytest

import oracle
from hearthline.bindings import catalog

FOLDER = "/root/testdata/sf0.001"
CHOSEN = (
    "degree_days storm_severity fema_ia_burden health_burden drought_scores storm_events_clean full_outer_merge "
    "winsorize_upper percentile_rank_average exact_quantiles min_rank kendall_tau_b component_scores compute_index "
    "nearest_year_asof_join zone_explode_join name_crosswalk_join scan_ghcn_csv scan_recs_csv scan_acs_json "
    "scan_series_json write_year_partitions dedup_first slug_item_code parse_number wide_pivot annual_index "
    "covered_smoke_days point_in_polygon_join range_distance_join incremental_year_load contribution_stability"
).split()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    function, sql = catalog()[name]
    text, good = oracle.compare(spark, duck, FOLDER, function, sql)
    assert good, text


def test_every_query_is_callable_and_named_once():
    table = catalog()
    assert all(callable(f) for f, _ in table.values())
    without_sql = [n for n, (_, sql) in table.items() if sql is None]
    assert sorted(without_sql) == ["correlation_pvalues"]
