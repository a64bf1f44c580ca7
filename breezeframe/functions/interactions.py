"""Twelve pollutant/weather interaction features (training definitions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import at_least

# --- Fixed values: names and the columns each interaction needs -------------
INPUTS = {
    "interact_pm25_humidity": ("pm25", "humidity"),
    "interact_pm10_wind_accum": ("pm10", "wind_speed"),
    "interact_temp_o3": ("temperature", "o3"),
    "interact_co_pm25": ("co", "pm25"),
    "interact_temp_humidity": ("temperature", "humidity"),
    "interact_wind_humidity": ("wind_speed", "humidity"),
    "interact_pm25_pm10_ratio": ("pm25", "pm10"),
    "interact_no2_co": ("no2", "co"),
    "interact_pressure_temp_stability": ("pressure", "temperature"),
    "interact_lag_aqi1_winter": ("lag_aqi_1", "season_Winter"),
    "interact_pm25_stubble": ("pm25", "is_stubble_burning"),
    "interact_wind_speed_sq": ("wind_speed",),
}
STANDARD_PRESSURE = 1013.0
TEMPERATURE_SHIFT = 30.0
MAX_RATIO = 2.0


def interactions(available: list[str] | None = None, places: int = 4) -> dict[str, Column]:
    """The interactions whose inputs are ``available`` (all of them by default)."""
    c = F.col
    percent = F.lit(100.0)
    formulas = {
        "interact_pm25_humidity": c("pm25") * c("humidity") / percent,
        "interact_pm10_wind_accum": c("pm10") / (c("wind_speed") + F.lit(1.0)),
        "interact_temp_o3": c("temperature") * c("o3") / percent,
        "interact_co_pm25": c("co") * c("pm25"),
        "interact_temp_humidity": c("temperature") * c("humidity") / percent,
        "interact_wind_humidity": c("wind_speed") * c("humidity") / percent,
        "interact_pm25_pm10_ratio": _capped(c("pm25") / at_least(c("pm10"), 1.0)),
        "interact_no2_co": c("no2") * c("co"),
        "interact_pressure_temp_stability": c("pressure")
        / STANDARD_PRESSURE
        / at_least(c("temperature") + TEMPERATURE_SHIFT, 1.0)
        * percent,
        "interact_lag_aqi1_winter": c("lag_aqi_1") * c("season_Winter"),
        "interact_pm25_stubble": c("pm25") * c("is_stubble_burning"),
        "interact_wind_speed_sq": c("wind_speed") * c("wind_speed"),
    }
    have = set(available) if available is not None else None
    return {
        name: F.round(expr, places)
        for name, expr in formulas.items()
        if have is None or have.issuperset(INPUTS[name])
    }


def _capped(ratio: Column) -> Column:
    return F.when(ratio.isNotNull(), F.least(ratio, F.lit(MAX_RATIO)))
