from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

# One query per family; `python tools/compare.py` runs all of them.
SAMPLE = [
    "flagship_persistence_scores", "p8_mixed_timestamp_formats", "w13_keep_first_per_key", "a1_hourly_grid",
    "w9_time_interpolation", "a11_iqr_fences", "a3_missing_report", "w1_lags", "w5_rolling_trend", "n6_interactions",
    "j4_nearest_reading", "j6_distance_blend", "j7_calendar_with_fallback", "a2_descriptive_statistics",
    "a25_pearson_matrix", "a34_regression_scores", "m4_ridge_regression", "a38_attribution_roll_up",
    "p13_request_validation", "s6_report_text_scan",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, sf, name):
    ok, text = compare(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name])
    assert ok, text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["model", "episode", "station", "n", "rmse", "mae", "mape", "smape", "r2"]
    assert df.count() > 0
