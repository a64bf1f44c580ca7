"""Daily readings to the full feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.timeline import Timeline
from ..functions import calendar as cal
from ..functions.interactions import interactions
from ..operators import history, splits, stations

# --- Fixed values: the curated model inputs (59) and sequence inputs (41) ---
MODEL_FEATURES = (
    "roll_mean_aqi_7", "roll_mean_aqi_30", "roll_std_aqi_7", "roll_trend_aqi_7", "roll_trend_aqi_30",
    "roll_aqi_momentum", "roll_episode_flag", "roll_mean_pm25_7", "roll_mean_pm10_7", "roll_std_pm25_7",
    "lag_aqi_1", "lag_aqi_7", "lag_aqi_14", "lag_aqi_30", "lag_pm25_1", "lag_pm25_7",
    "lag_pm10_1", "lag_co_1", "lag_no2_1", "lag_temperature_1", "lag_wind_speed_1",
    "pm25", "pm10", "co", "no2", "o3", "so2", "nh3",
    "temperature", "humidity", "wind_speed", "pressure",
    "sin_month", "cos_month", "sin_day_of_year", "cos_day_of_year", "sin_day_of_week", "cos_day_of_week",
    "season_Winter", "season_Monsoon", "season_Summer", "season_Spring",
    "year", "quarter", "is_weekend", "is_covid_lockdown", "is_diwali", "is_stubble_burning",
    "aqi_saturated", "station_encoded", "station_season_mean_winter",
    "interact_pm25_humidity", "interact_pm25_pm10_ratio", "interact_co_pm25", "interact_pm10_wind_accum",
    "interact_temp_o3", "interact_lag_aqi1_winter", "interact_wind_speed_sq", "interact_pm25_stubble",
)
SEQUENCE_FEATURES = (
    "aqi", "pm25", "pm10", "no2", "nh3", "so2", "co", "o3", "pb",
    "temperature", "humidity", "wind_speed", "pressure",
    "lag_aqi_1", "lag_aqi_3", "lag_aqi_7", "lag_pm25_1", "lag_pm10_1", "lag_temperature_1",
    "lag_wind_speed_1", "roll_mean_aqi_7", "roll_std_aqi_7", "roll_trend_aqi_7", "roll_mean_pm25_7",
    "roll_aqi_momentum", "sin_month", "cos_month", "sin_day_of_year", "cos_day_of_year",
    "sin_day_of_week", "cos_day_of_week", "is_covid_lockdown", "is_diwali", "season_Spring",
    "is_weekend", "aqi_saturated", "station_encoded", "interact_pm25_humidity",
    "interact_pm25_pm10_ratio", "interact_lag_aqi1_winter", "interact_pm25_stubble",
)
# --- Fixed values: column families of the inventory -------------------------
IDENTIFIERS = ("date", "station", "aqi", "aqi_category", "split", "season")
RAW = (
    "pm25", "pm10", "no2", "nh3", "so2", "co", "o3", "pb",
    "temperature", "humidity", "wind_speed", "wind_direction", "pressure",
)
EVENTS = (
    "is_covid_lockdown", "is_diwali", "is_stubble_burning", "is_holiday", "aqi_saturated", "is_weekend",
)
CALENDAR = ("year", "month", "day", "day_of_week", "day_of_year", "week_of_year", "quarter")
PREFIXES = (
    ("lag_", "lag"),
    ("roll_", "rolling"),
    ("interact_", "interaction"),
    ("station_", "station"),
    ("sin_", "temporal_cyclical"),
    ("cos_", "temporal_cyclical"),
    ("season_", "temporal_season_ohe"),
)


def add_temporal(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Calendar, cyclical, season and event columns."""
    d = F.col("date")
    aqi = F.col("aqi") if "aqi" in df.columns and "aqi_saturated" not in df.columns else None
    out = df.withColumns({**cal.calendar_parts(d), **cal.cyclical_parts(d)})
    out = out.withColumn("season", cal.season(F.col("month")))
    out = out.withColumns({**cal.season_flags(F.col("season")), **cal.event_flags(d, aqi)})
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(0))
    return stations.add_holidays(out, holidays)


def drop_warm_up(df: DataFrame, longest: int = max(history.LAGS)) -> DataFrame:
    """Remove rows that lie too early in their series to have the longest lag."""
    return df.where(F.col(f"lag_aqi_{longest}").isNotNull())


def build_features(
    df: DataFrame,
    codes: Mapping[str, int],
    train_end: str = splits.TRAIN_END,
    val_end: str = splits.VAL_END,
    holidays: DataFrame | None = None,
    warm_up: bool = True,
    timeline: Timeline = Timeline(),
) -> DataFrame:
    """All feature columns. Look-backs share one shuffle; station statistics come from training rows,
    warm-up rows included, which are dropped only afterwards."""
    temporal = add_temporal(df, holidays)
    looked_back = history.add_history(temporal, timeline=timeline)
    combined = looked_back.withColumns(interactions(looked_back.columns))
    labelled = combined.withColumn(
        "split", splits.calendar_split(F.col("date"), train_end, val_end)
    )
    # The statistics need five columns of the input, not the look-backs.
    train = temporal.where(F.col("date") <= F.lit(train_end).cast("date"))
    learned = stations.learn_stations(train)
    grand = train.agg(F.avg("aqi").alias("g")).scalar()
    joined = stations.add_station_statistics(labelled, learned)
    season_cols = [stations.season_column(s) for s in cal.SEASONS]
    filled = joined.withColumns({c: F.coalesce(F.col(c), grand) for c in season_cols})
    encoded = stations.encode_stations(filled, codes)
    return drop_warm_up(encoded) if warm_up else encoded


def family(column: str) -> str:
    if column in RAW:
        return "raw_pollutants"
    for prefix, name in PREFIXES:
        if column.startswith(prefix):
            return name
    if column in EVENTS:
        return "temporal_events"
    if column in CALENDAR:
        return "temporal_calendar"
    return "other"


def feature_names(columns: Sequence[str]) -> list[str]:
    return sorted(c for c in columns if c not in IDENTIFIERS)


def inventory(df: DataFrame) -> DataFrame:
    """Family and number of known values of every feature column."""
    entries = [
        F.struct(F.lit(c).alias("feature"), F.lit(family(c)).alias("family"), F.count(c).alias("known"))
        for c in feature_names(df.columns)
    ]
    packed = df.agg(F.array(*entries).alias("_e"))
    return packed.select(F.explode("_e").alias("_e")).select("_e.*")
