"""Time the named queries; prints one JSON line.

Every query runs once to warm up and then ``BENCH_RUNS`` times (once by default); the median counts.
A result is forced with the ``noop`` sink. Building the query, which may run jobs of its own, is
part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyframe.plans import all_queries  # noqa: E402
from tallyframe.session import local_session  # noqa: E402

HEADLINE = """
outcome_share outcome_share_home_away pair_counts_either_side pair_outcomes_pivot
top5_places_by_flag avg_margin_by_year_pivot within_days_left_on within_days_left_filter
latest_per_group_join date_text_roundtrip csv_roundtrip_keep_empty quality_report series_prepare
series_prepare_by_chunk rank_last_day growth_top10_stats entity_features growth_params_choice
forecast_submission threshold_dates multi_stat_by_key multi_stat_grouping_sets table_stats
describe_exact mad_by_key corr_matrix_long standardise_features pca_2d kmeans_labels ward_labels
dbscan_labels point_regions image_crop_grey
""".split()


def timed(spark, folder: str, fn) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, 8)
    known = all_queries()
    times = {}
    for name in names:
        timed(spark, folder, known[name])
        times[name] = round(
            statistics.median(timed(spark, folder, known[name]) for _ in range(runs)), 3
        )
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    out = {
        "metric": "sum of median query times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": scale,
        "cpus": cpus,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
