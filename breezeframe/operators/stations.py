"""Station statistics learned on training rows and joined back as features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.shared import materialise
from ..functions.calendar import SEASONS

# --- Fixed values: source column per learned statistic ----------------------
STATION_MEANS = {
    "station_mean_aqi": "aqi",
    "station_mean_pm25": "pm25",
    "station_mean_pm10": "pm10",
    "station_mean_temp": "temperature",
}
UNKNOWN_STATION = -1


def season_column(season: str) -> str:
    return f"station_season_mean_{season.lower()}"


def learn_stations(train: DataFrame, places: int = 4) -> DataFrame:
    """Per-station statistics, seasonal means and offset from the grand mean; one row per station."""
    grand = train.agg(F.avg("aqi").alias("g")).scalar()
    stats = train.groupBy("station").agg(
        *[F.round(F.avg(c), places).alias(n) for n, c in STATION_MEANS.items()],
        F.round(F.stddev_samp("aqi"), places).alias("station_std_aqi"),
        *[
            F.round(F.avg(F.when(F.col("season") == s, F.col("aqi"))), places).alias(season_column(s))
            for s in SEASONS
        ],
    )
    filled = {season_column(s): F.coalesce(F.col(season_column(s)), grand) for s in SEASONS}
    learned = stats.withColumns(filled).withColumn(
        "station_aqi_offset", F.round(F.col("station_mean_aqi") - grand, places)
    )
    return materialise(learned, "stations")


def season_means(train: DataFrame, places: int = 4) -> DataFrame:
    """Station by season pivot; a missing combination takes the grand mean."""
    grand = train.agg(F.avg("aqi").alias("g")).scalar()
    pivot = train.groupBy("station").pivot("season", list(SEASONS)).agg(F.round(F.avg("aqi"), places))
    return materialise(pivot.withColumns({s: F.coalesce(F.col(s), grand) for s in SEASONS}), "seasons")


def encode_stations(df: DataFrame, codes: Mapping[str, int]) -> DataFrame:
    """Integer code per known station, -1 otherwise."""
    code = F.lit(UNKNOWN_STATION)
    for name, value in codes.items():
        code = F.when(F.col("station") == name, F.lit(value)).otherwise(code)
    return df.withColumn("station_encoded", code.cast("int"))


def encode_from_table(df: DataFrame, codes: DataFrame) -> DataFrame:
    """As ``encode_stations`` for a code table (station, code) of any size; it is stored, so the join knows its size."""
    codes = materialise(codes.select("station", F.col("code").alias("_code")), "codes")
    return (
        df.join(codes, "station", "left")
        .withColumn("station_encoded", F.coalesce("_code", F.lit(UNKNOWN_STATION)).cast("int"))
        .drop("_code")
    )


def add_station_statistics(df: DataFrame, learned: DataFrame) -> DataFrame:
    """Left lookup of the learned columns; stations without training rows take the grand seasonal mean
    when the learned table provides it, else null."""
    return df.join(learned, "station", "left")


def add_season_means(df: DataFrame, pivot: DataFrame, grand: DataFrame) -> DataFrame:
    """Left lookup of the seasonal pivot; unknown stations take the grand mean of ``grand``."""
    g = grand.agg(F.avg("aqi").alias("g")).scalar()
    named = pivot.select("station", *[F.col(s).alias(season_column(s)) for s in SEASONS])
    joined = df.join(named, "station", "left")
    return joined.withColumns(
        {season_column(s): F.coalesce(F.col(season_column(s)), g) for s in SEASONS}
    )


def add_holidays(df: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """1 on listed days, else 0. ``holidays`` may repeat dates; the distinct days are stored, so the join knows their size."""
    days = materialise(holidays.select(F.col("date").cast("date").alias("_day")).distinct(), "holidays")
    joined = df.join(days, df[date].cast("date") == days["_day"], "left")
    return joined.withColumn("is_holiday", F.col("_day").isNotNull().cast("int")).drop("_day")
