"""Small frames shared by the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

START = dt.datetime(2023, 1, 1)


def irregular(seed: int = 7, sizes: dict[str, int] | None = None) -> pd.DataFrame:
    """A hot station, a normal one and a sparse one, with gaps in time and values."""
    rng = np.random.default_rng(seed)
    frames = []
    for name, n in (sizes or {"hot": 700, "mid": 120, "sparse": 9}).items():
        step = rng.exponential(1.0, n) * {"hot": 600, "mid": 9_000}.get(name, 2_000_000) + 1
        at = [START + dt.timedelta(seconds=int(s)) for s in np.cumsum(np.ceil(step))]
        x = rng.normal(100, 20, n)
        x[rng.random(n) < 0.2] = np.nan
        frames.append(pd.DataFrame({"station": name, "date": at, "x": x, "y": rng.normal(50, 5, n)}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark: SparkSession, pdf: pd.DataFrame, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(",")]
    rows = [
        tuple(None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r)
        for r in pdf[names].itertuples(index=False)
    ]
    return spark.createDataFrame(rows, schema)


IRREGULAR = "station string, date timestamp_ntz, x double, y double"


def daily_series(stations: int = 2, days: int = 120, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frames = []
    for s in range(stations):
        t = np.arange(days)
        aqi = 200 + 60 * np.sin(t / 9 + s) + rng.normal(0, 15, days)
        frames.append(
            pd.DataFrame(
                {
                    "station": f"s{s}",
                    "date": [(START + dt.timedelta(days=int(d))).date() for d in t],
                    "aqi": aqi,
                    "pm25": aqi * 0.4 + rng.normal(0, 5, days),
                    "pm10": aqi * 0.7 + rng.normal(0, 8, days),
                    "no2": rng.uniform(10, 60, days),
                    "so2": rng.uniform(2, 20, days),
                    "co": rng.uniform(0.5, 3, days),
                    "o3": rng.uniform(20, 80, days),
                    "nh3": rng.uniform(5, 30, days),
                    "temperature": 25 + 8 * np.sin(t / 20) + rng.normal(0, 1, days),
                    "humidity": rng.uniform(30, 90, days),
                    "wind_speed": rng.uniform(0.5, 8, days),
                    "pressure": rng.normal(1005, 4, days),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


DAILY = (
    "station string, date date, aqi double, pm25 double, pm10 double, no2 double, so2 double, co double, "
    "o3 double, nh3 double, temperature double, humidity double, wind_speed double, pressure double"
)
