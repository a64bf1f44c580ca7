"""Observation schema: column specs, aliases, layouts and physical limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str
    required: bool
    unit: str
    low: float | None = None
    high: float | None = None


# --- Fixed values: canonical columns, units and physical limits -------------
SPECS = (
    Spec("date", "timestamp", True, "datetime"),
    Spec("station", "string", True, "id"),
    Spec("aqi", "double", True, "index", 0.0, 500.0),
    Spec("pm25", "double", False, "ug/m3", 0.0, 1000.0),
    Spec("pm10", "double", False, "ug/m3", 0.0, 1500.0),
    Spec("no2", "double", False, "ug/m3", 0.0, 500.0),
    Spec("so2", "double", False, "ug/m3", 0.0, 500.0),
    Spec("co", "double", False, "mg/m3", 0.0, 50.0),
    Spec("o3", "double", False, "ug/m3", 0.0, 500.0),
    Spec("nh3", "double", False, "ug/m3", 0.0, 500.0),
    Spec("temperature", "double", False, "degC", -5.0, 55.0),
    Spec("humidity", "double", False, "%", 0.0, 100.0),
    Spec("wind_speed", "double", False, "m/s", 0.0, 50.0),
    Spec("pressure", "double", False, "hPa", 800.0, 1100.0),
)

# --- Fixed values: raw header -> canonical column ---------------------------
ALIASES = {
    "datetime": "date",
    "timestamp": "date",
    "date_time": "date",
    "time": "date",
    "Date": "date",
    "Timestamp": "date",
    "AQI": "aqi",
    "aqi_value": "aqi",
    "air_quality_index": "aqi",
    "PM2.5": "pm25",
    "pm2.5": "pm25",
    "PM25": "pm25",
    "pm_2_5": "pm25",
    "PM2_5": "pm25",
    "PM10": "pm10",
    "PM_10": "pm10",
    "NO2": "no2",
    "SO2": "so2",
    "CO": "co",
    "O3": "o3",
    "NH3": "nh3",
    "temp": "temperature",
    "Temp": "temperature",
    "Temperature": "temperature",
    "RH": "humidity",
    "relative_humidity": "humidity",
    "Humidity": "humidity",
    "WS": "wind_speed",
    "wind speed": "wind_speed",
    "WindSpeed": "wind_speed",
    "BP": "pressure",
    "atm_pressure": "pressure",
    "Pressure": "pressure",
    "Station": "station",
    "station_id": "station",
    "StationName": "station",
}

# --- Fixed values: timestamp formats, tried in this order -------------------
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd",
    "dd-MM-yyyy",
)

# --- Fixed values: report layouts, cell position -> column ------------------
# "_category" is read for checking and dropped again.
LAYOUTS = {
    "annual": ("date", "aqi", "pm25", "pm10", "no2", "so2", "co", "o3", "nh3", "pb"),
    "meteo": (
        "date", "aqi", "_category", "pm25", "pm10", "no2", "nh3", "so2", "co", "o3", "pb",
        "temperature", "humidity", "wind_speed", "wind_direction", "pressure",
    ),
    "short": ("date", "aqi", "pm25", "pm10", "no2", "so2", "co", "o3", "nh3", "pb"),
}
LAYOUT_WIDTHS = {"short": 10, "annual": 11, "meteo": 15}
MIN_FILLED_CELLS = 3

# --- Fixed values: columns that can never be negative -----------------------
NON_NEGATIVE = (
    "aqi", "pm25", "pm10", "no2", "so2", "co", "o3", "nh3", "humidity", "wind_speed",
)

# --- Fixed values: limits of the older, wider quality check -----------------
QUALITY_LIMITS = {
    "aqi": (0.0, 500.0),
    "pm25": (0.0, 1000.0),
    "pm10": (0.0, 1500.0),
    "no": (0.0, 500.0),
    "no2": (0.0, 500.0),
    "nox": (0.0, 1000.0),
    "nh3": (0.0, 500.0),
    "co": (0.0, 50.0),
    "so2": (0.0, 500.0),
    "o3": (0.0, 500.0),
    "benzene": (0.0, 100.0),
    "toluene": (0.0, 200.0),
    "xylene": (0.0, 200.0),
    "temperature": (-5.0, 55.0),
    "humidity": (0.0, 100.0),
    "wind_speed": (0.0, 50.0),
    "wind_direction": (0.0, 360.0),
    "rainfall": (0.0, 500.0),
}

KEY = ("station", "date")
KEY_COLUMNS_FOR_DROP = ("aqi", "pm25", "pm10")
POLLUTANTS = ("pm25", "pm10", "no2", "so2", "co", "o3", "nh3")
METEO = ("temperature", "humidity", "wind_speed", "pressure")
EXTENDED = ("pb", "wind_direction")
NUMERIC = tuple(s.name for s in SPECS if s.kind == "double")
LIMITS = {s.name: (s.low, s.high) for s in SPECS if s.kind == "double"}
REQUIRED = tuple(s.name for s in SPECS if s.required)
OPTIONAL = tuple(s.name for s in SPECS if not s.required)


def observation_schema(*, text: bool = False) -> T.StructType:
    """The canonical schema; ``text=True`` types every field as string for lossless reading."""
    kinds = {"timestamp": T.TimestampNTZType(), "string": T.StringType(), "double": T.DoubleType()}
    return T.StructType(
        [
            T.StructField(
                s.name,
                T.StringType() if text else kinds[s.kind],
                True,
                {"unit": s.unit, "min": s.low, "max": s.high, "required": s.required},
            )
            for s in SPECS
        ]
    )
