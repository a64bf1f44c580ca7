"""Headline queries, warm, median of three; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks
from tools.compare import session

QUERIES = (
    "flagship_persistence_scores",
    "a1_hourly_grid",
    "w9_time_interpolation",
    "w13_keep_first_per_key",
    "w1_lags",
    "w2_rolling_mean",
    "w5_rolling_trend",
    "feature_table",
    "a2_descriptive_statistics",
    "a11_iqr_fences",
    "w11_longest_null_run",
    "a25_pearson_matrix",
    "a28_autocorrelation",
    "a34_regression_scores",
    "a36_residual_histogram",
    "j4_nearest_reading",
    "j6_distance_weights",
    "w15_sliding_sequences",
    "m3_linear_regression",
    "m4_ridge_regression",
    "s6_report_text_scan",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    queries = checks.queries()
    timings = {}
    for name in QUERIES:
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_warm_median_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
