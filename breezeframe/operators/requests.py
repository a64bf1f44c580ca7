"""Scenario requests: checking, completing and applying overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import STUBBLE_MONTHS, cycle, season, season_flags
from ..functions.numeric import clamp

# --- Fixed values: request limits, required fields and time format ----------
REQUEST_LIMITS = {
    "pm25": (0.0, 1000.0),
    "pm10": (0.0, 1000.0),
    "no2": (0.0, 1000.0),
    "temperature": (-50.0, 60.0),
    "humidity": (0.0, 100.0),
    "wind_speed": (0.0, 250.0),
}
MODELS = ("HistGradientBoosting", "DecisionTree", "LSTM", "GRU", "CNN-LSTM")
TIME_PATTERN = r"^\d{2}:\d{2}$"

# --- Fixed values: floors when a delta is applied ---------------------------
DELTA_FLOORS = {
    "pm25": 1.0,
    "pm10": 1.0,
    "no2": 0.1,
    "so2": 0.1,
    "co": 0.01,
    "o3": 0.1,
    "wind_speed": 0.0,
}
DELTA_RANGE = {"humidity": (0.0, 100.0)}
DELTA_COLUMNS = ("pm25", "pm10", "no2", "so2", "co", "o3", "temperature", "humidity", "wind_speed")


def check_requests(
    df: DataFrame, stations: Sequence[str], models: Sequence[str] = MODELS
) -> DataFrame:
    """Add ``reasons`` (array) and ``valid``; fields arrive as text."""
    tests: list[Column] = []
    for c, (lo, hi) in REQUEST_LIMITS.items():
        number = F.col(c).try_cast("double")
        tests += [
            F.when(F.col(c).isNull(), F.lit(f"missing {c}")),
            F.when(F.col(c).isNotNull() & number.isNull(), F.lit(f"not a number: {c}")),
            F.when(number.isNotNull() & ~number.between(lo, hi), F.lit(f"out of bounds: {c}")),
        ]
    tests += [
        F.when(~F.coalesce(F.col("station").isin(*stations), F.lit(False)), F.lit("unknown station")),
        F.when(~F.coalesce(F.col("model").isin(*models), F.lit(False)), F.lit("unknown model")),
        F.when(F.col("date").isNotNull() & ~_is_date(F.col("date")), F.lit("bad date")),
        F.when(F.col("time").isNotNull() & ~_is_time(F.col("time")), F.lit("bad time")),
    ]
    checked = df.withColumn("reasons", F.array_compact(F.array(*tests)))
    return checked.withColumn("valid", (F.size("reasons") == 0).cast("int"))


def _is_date(c: Column) -> Column:
    return (F.length(c) == 10) & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()


def _is_time(c: Column) -> Column:
    hours = F.substring(c, 1, 2).try_cast("int")
    minutes = F.substring(c, 4, 2).try_cast("int")
    fits = c.rlike(TIME_PATTERN) & hours.between(0, 23) & minutes.between(0, 59)
    return F.coalesce(fits, F.lit(False))


def what_if(
    scenarios: DataFrame, train: DataFrame, features: Sequence[str], month: str = "month"
) -> DataFrame:
    """Scenario values where given, training means elsewhere, then the month-dependent terms."""
    mean_row = train.agg(F.struct(*[F.avg(c).alias(c) for c in features]).alias("m")).scalar()
    base = scenarios.withColumn("_m", mean_row)
    given = set(scenarios.columns)
    filled = base.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}")) if c in given else F.col(f"_m.{c}")
            for c in features
        }
    ).drop("_m")
    return filled.withColumns(month_terms(F.col(month)))


def month_terms(month: Column) -> dict[str, Column]:
    """Cyclical and seasonal terms that follow from a month alone (day of year as 30 x month)."""
    sin_m, cos_m = cycle(month, 12.0)
    sin_d, cos_d = cycle(month * 30, 365.25)
    flags = season_flags(season(month))
    return {
        "sin_month": sin_m,
        "cos_month": cos_m,
        "sin_day_of_year": sin_d,
        "cos_day_of_year": cos_d,
        "is_stubble_burning": month.isin(*STUBBLE_MONTHS).cast("int"),
        **{k: v for k, v in flags.items() if k != "season_Post_Monsoon"},
    }


def apply_deltas(future: DataFrame, deltas: DataFrame, on: str) -> DataFrame:
    """Add each scenario's deltas (columns ``d_<name>``) to its future rows, keeping the floors."""
    joined = future.join(deltas, on)
    out = {}
    for c in DELTA_COLUMNS:
        moved = F.col(c) + F.coalesce(F.col(f"d_{c}"), F.lit(0.0))
        if c in DELTA_FLOORS:
            moved = F.when(moved.isNotNull(), F.greatest(moved, F.lit(DELTA_FLOORS[c])))
        elif c in DELTA_RANGE:
            moved = clamp(moved, *DELTA_RANGE[c])
        out[c] = moved
    return joined.withColumns(out).select(*future.columns)


def override_deltas(requests: DataFrame, base: DataFrame, on: str) -> DataFrame:
    """Requested value minus base value per column; no request means no change."""
    asked = requests.select(on, *[F.col(c).alias(f"_o_{c}") for c in DELTA_COLUMNS if c in requests.columns])
    joined = base.join(asked, on)
    cols = [
        (
            F.coalesce(F.col(f"_o_{c}"), F.col(c)) - F.col(c)
            if f"_o_{c}" in asked.columns
            else F.lit(0.0)
        ).alias(f"d_{c}")
        for c in DELTA_COLUMNS
    ]
    return joined.select(on, *cols)
