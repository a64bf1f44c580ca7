"""Calendar, cyclical, season and event expressions over a date or timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: seasons by month, one map per scheme ---------------------
SEASONS = ("Winter", "Spring", "Summer", "Monsoon", "Post_Monsoon")
SEASON_MONTHS = {
    "training": {
        "Winter": (11, 12, 1, 2),
        "Spring": (3, 4),
        "Summer": (5, 6),
        "Monsoon": (7, 8, 9),
        "Post_Monsoon": (10,),
    },
    "api": {
        "Winter": (12, 1, 2),
        "Spring": (3, 4),
        "Summer": (5, 6),
        "Monsoon": (7, 8, 9),
        "Post_Monsoon": (10, 11),
    },
}
# --- Fixed values: event periods and cycle lengths --------------------------
LOCKDOWN = ("2020-03-24", "2021-06-30")
FESTIVAL_FROM, FESTIVAL_TO = (10, 20), (11, 5)
STUBBLE_MONTHS = (10, 11)
SATURATED_AQI = 500
PERIODS = {"month": 12.0, "day_of_year": 365.25, "day_of_week": 7.0, "week_of_year": 52.0}
HOURS_PER_DAY = 24.0


def calendar_parts(d: Column) -> dict[str, Column]:
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
    }


def cycle(x: Column, period: float, places: int = 6) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * x / F.lit(period)
    return F.round(F.sin(angle), places), F.round(F.cos(angle), places)


def cyclical_parts(d: Column) -> dict[str, Column]:
    parts = calendar_parts(d)
    out: dict[str, Column] = {}
    for name, period in PERIODS.items():
        out[f"sin_{name}"], out[f"cos_{name}"] = cycle(parts[name], period)
    return out


def hour_cycle(t: Column) -> dict[str, Column]:
    s, c = cycle(F.hour(t), HOURS_PER_DAY)
    return {"hour_sin": s, "hour_cos": c}


def season(month: Column, scheme: str = "training") -> Column:
    expr = F.lit(None).cast("string")
    for name, months in SEASON_MONTHS[scheme].items():
        expr = F.when(month.isin(*months), F.lit(name)).otherwise(expr)
    return expr


def season_flags(label: Column) -> dict[str, Column]:
    return {f"season_{s}": (label == s).cast("int") for s in SEASONS}


def event_flags(d: Column, aqi: Column | None = None) -> dict[str, Column]:
    month, day = F.month(d), F.dayofmonth(d)
    lockdown = (d >= F.lit(LOCKDOWN[0]).cast("date")) & (d <= F.lit(LOCKDOWN[1]).cast("date"))
    festival = ((month == FESTIVAL_FROM[0]) & (day >= FESTIVAL_FROM[1])) | (
        (month == FESTIVAL_TO[0]) & (day <= FESTIVAL_TO[1])
    )
    out = {
        "is_covid_lockdown": lockdown.cast("int"),
        "is_diwali": festival.cast("int"),
        "is_stubble_burning": month.isin(*STUBBLE_MONTHS).cast("int"),
    }
    if aqi is not None:
        out["aqi_saturated"] = F.coalesce(aqi == SATURATED_AQI, F.lit(False)).cast("int")
    return out


def month_name(month: Column) -> Column:
    """Three-letter month name of a month number."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")
