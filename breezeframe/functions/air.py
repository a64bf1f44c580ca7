"""Air-quality classes, advisories, forecast bands and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: class limits (right-closed) and names --------------------
CLASS_UPPER = (50.0, 100.0, 200.0, 300.0, 400.0, 501.0)
CLASS_NAMES = ("good", "satisfactory", "moderate", "poor", "very_poor", "severe")
CLASS_TITLES = ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe")

# --- Fixed values: advisory limits and wordings, last entry has no limit ----
ADVISORY_UPPER = (50.0, 100.0, 150.0, 200.0, 300.0)
ADVISORIES = {
    "forecast": (
        "Minimal health impact. Air quality is considered satisfactory.",
        "Minor breathing discomfort to sensitive people.",
        "Sensitive individuals should consider reducing prolonged outdoor exertion.",
        "Active children/adults should limit prolonged outdoor exertion.",
        "Significant health risk across all cohorts. Reduce outdoor footprint.",
        "Emergency thresholds exceeded. Wear N95 masks outdoors.",
    ),
    "lookup": (
        "Air quality is satisfying, and air pollution poses little or no risk.",
        "Air quality is acceptable. However, active children and adults should limit prolonged outdoor exertion.",
        "Members of sensitive groups may experience health effects. The general public is less likely to be affected.",
        "Active children and adults, and people with respiratory disease, should avoid prolonged outdoor exertion.",
        "Everyone should avoid prolonged outdoor exertion. Sensitive groups should remain indoors.",
        "Health alert: everyone may experience more serious health effects. Stay indoors and use air filters.",
    ),
}
RISK_UPPER = (50.0, 100.0, 200.0, 300.0)
RISKS = ("Minimal", "Slight", "Moderate", "High", "Severe")

# --- Fixed values: forecast bands and read-out horizons ---------------------
BANDS = {"api": (9.2, 0.35), "screen": (8.0, 0.25)}
CONFIDENCE = (98.0, 0.28, 75.0)
HORIZONS = (1, 3, 6, 12, 24, 48, 72)
PM25_SHARE = 0.6


def _tier(x: Column, upper: tuple, labels: tuple, last: object | None = None) -> Column:
    expr = F.lit(labels[len(upper)] if len(labels) > len(upper) else last)
    for limit, label in reversed(list(zip(upper, labels, strict=False))):
        expr = F.when(x <= limit, F.lit(label)).otherwise(expr)
    return F.when(x.isNotNull(), expr)


def aqi_class(aqi: Column) -> Column:
    """Ordinal class 0-5 with right-closed bins; null outside [0, 501]."""
    return F.when(aqi >= 0, _tier(aqi, CLASS_UPPER, tuple(range(6)))).cast("int")


def aqi_class_name(aqi: Column) -> Column:
    return F.when(aqi >= 0, _tier(aqi, CLASS_UPPER, CLASS_NAMES))


def advisory(aqi: Column, wording: str = "forecast") -> Column:
    return _tier(aqi, ADVISORY_UPPER, ADVISORIES[wording])


def risk_class(aqi: Column) -> Column:
    return _tier(aqi, RISK_UPPER, RISKS)


def main_pollutant(pm25: Column, pm10: Column) -> Column:
    return F.when(pm25 > pm10 * PM25_SHARE, F.lit("PM2.5")).otherwise(F.lit("PM10"))


def band(value: Column, hours: Column, kind: str = "api") -> tuple[Column, Column]:
    base, slope = BANDS[kind]
    half = F.lit(base) + hours * F.lit(slope)
    if kind == "screen":
        half = F.round(half)
    return F.greatest(F.lit(0.0), value - half), value + half


def confidence(hours: Column) -> Column:
    top, slope, floor = CONFIDENCE
    return F.greatest(F.lit(floor), F.lit(top) - hours * F.lit(slope))


def horizon_label(hours: Column) -> Column:
    days = F.floor(hours / 24).cast("string")
    return F.when(hours < 24, F.concat(F.lit("+"), hours.cast("string"), F.lit(" hours"))).otherwise(
        F.concat(F.lit("+"), days, F.lit(" days"))
    )


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
