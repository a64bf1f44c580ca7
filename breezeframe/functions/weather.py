"""Daily weather curves for scenario steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import at_least, clamp

# --- Fixed values: (amplitude, phase hour) per curve and the floors ---------
TEMPERATURE_SWING, TEMPERATURE_PHASE = 5.0, 8.0
HUMIDITY_SWING, HUMIDITY_PHASE, HUMIDITY_RANGE = 15.0, 8.0, (10.0, 100.0)
WIND_SWING, WIND_PHASE, WIND_FLOOR = 2.0, 12.0, 1.0
PRESSURE_SWING, PRESSURE_PHASE = 2.0, 0.0
HOURS = 24.0


def _angle(hour: Column, phase: float) -> Column:
    return F.lit(2.0) * F.pi() * (hour - F.lit(phase)) / F.lit(HOURS)


def diurnal(
    hour: Column, temperature: Column, humidity: Column, wind: Column, pressure: Column
) -> dict[str, Column]:
    warm = F.sin(_angle(hour, TEMPERATURE_PHASE))
    return {
        "temperature": temperature + TEMPERATURE_SWING * warm,
        "humidity": clamp(
            humidity - HUMIDITY_SWING * F.sin(_angle(hour, HUMIDITY_PHASE)), *HUMIDITY_RANGE
        ),
        "wind_speed": at_least(wind + WIND_SWING * F.cos(_angle(hour, WIND_PHASE)), WIND_FLOOR),
        "pressure": pressure + PRESSURE_SWING * F.sin(_angle(hour, PRESSURE_PHASE)),
    }
