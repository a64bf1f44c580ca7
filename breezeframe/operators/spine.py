"""Calendar spines with climatological fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp

# --- Fixed values: last-resort value and limits of the calendar view --------
DEFAULT_AQI = 150.0
CALENDAR_LIMITS = (15.0, 500.0)
DEFAULT_MONTH_AQI = 150.0


def climatology(df: DataFrame, column: str = "aqi") -> DataFrame:
    """Mean by calendar day over all years and stations."""
    return df.groupBy(F.month("date").alias("month"), F.dayofmonth("date").alias("day")).agg(
        F.avg(column).alias(column)
    )


def daily_mean(df: DataFrame, column: str = "aqi") -> DataFrame:
    return df.groupBy(F.col("date").cast("date").alias("date")).agg(F.avg(column).alias(column))


def year_calendar(df: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Every day of each year: the daily mean, else the climatology, else a constant; clipped."""
    spans = df.select(F.year("date").alias("year")).distinct() if years is None else years
    days = spans.select(
        F.explode(
            F.sequence(
                F.make_date("year", F.lit(1), F.lit(1)),
                F.make_date("year", F.lit(12), F.lit(31)),
                F.expr("INTERVAL 1 DAY"),
            )
        ).alias("date")
    )
    actual = daily_mean(df).withColumnRenamed("aqi", "_actual")
    usual = climatology(df).withColumnRenamed("aqi", "_usual")
    joined = (
        days.join(actual, "date", "left")
        .withColumns({"month": F.month("date"), "day": F.dayofmonth("date")})
        .join(usual, ["month", "day"], "left")
    )
    value = clamp(F.coalesce("_actual", "_usual", F.lit(DEFAULT_AQI)), *CALENDAR_LIMITS)
    return joined.select(
        "date",
        (F.dayofweek("date") - 1).alias("day_of_week"),
        (F.col("month") - 1).alias("month_index"),
        F.floor(value).cast("int").alias("aqi"),
        F.when(F.col("_actual").isNotNull(), "actual")
        .when(F.col("_usual").isNotNull(), "climatology")
        .otherwise("default")
        .alias("origin"),
    )
