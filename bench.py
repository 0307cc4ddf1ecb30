"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearthline.bindings import catalog  # noqa: E402
from hearthline.session import local_session  # noqa: E402

HEADLINE = (
    "degree_days", "classify_event_severity", "storm_severity", "fema_ia_burden", "drought_scores", "air_quality_scores",
    "health_burden", "energy_attribution", "flood_scores", "wildfire_scores", "harmonize", "percentile_rank_average",
    "theil_sen_slope", "pearson_matrix", "spearman_matrix", "distance_correlation", "compute_index", "jackknife",
    "severity_perturbation", "monte_carlo_weights", "stability_report", "nearest_year_asof_join", "zone_explode_join",
    "point_in_polygon_join", "range_distance_join", "slug_item_code", "nearest_polygon_join", "polygon_intersects_join",
    "raster_polygon_join", "idw_gap_fill", "kendall_tau_b", "correlation_robustness",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    table = catalog()
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    # One small job first, so that no query pays for starting the engine.
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        # The no-op sink computes every row without moving them to the driver.
        table[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
