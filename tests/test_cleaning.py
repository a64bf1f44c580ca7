from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breezeframe.core.timeline import Timeline
from breezeframe.operators import dedupe, fences, fill, grid, quality, schema_ops, splits
from breezeframe.plans.preprocess import Settings, fit_clean, preprocess, transform_clean

from .frames import IRREGULAR, START, irregular, to_spark

TL = Timeline(rows=40)


def raw_hourly(spark, n=600, stations=("north", "south"), seed=42):
    """Messy headers, missing values and spikes."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, s in enumerate(stations):
        aqi = 150 + 40 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 20, n) + 40 * k
        pm = 0.4 * aqi + rng.normal(0, 5, n)
        pm[rng.random(n) < 0.02] = rng.uniform(800, 2000)
        for i in range(n):
            if i % 17 == 3:
                continue
            rows.append(
                (
                    START + dt.timedelta(hours=i),
                    s,
                    float(np.clip(aqi[i], 30, 450)),
                    None if rng.random() < 0.05 else float(pm[i]),
                    float(0.6 * aqi[i]),
                    str(round(float(rng.uniform(5, 50)), 2)) if i % 50 else "bad",
                    float(rng.uniform(0, 8)),
                )
            )
    return spark.createDataFrame(
        rows, "`Timestamp` timestamp_ntz, Station string, AQI double, `PM2.5` double, PM10 double, NO2 string, WS double"
    )


def test_preprocess_end_to_end(spark):
    s = Settings(axis="row", min_valid=0.4, gap=12, timeline=TL)
    out = preprocess(raw_hourly(spark), s)
    clean = out.clean.cache()
    assert set(out.state.dropped) == {"so2", "co", "o3", "nh3", "temperature", "humidity", "pressure"}
    per = {r["station"]: r["count"] for r in clean.groupBy("station").count().collect()}
    assert per == {"north": 600, "south": 600}
    for c in out.state.columns:
        assert clean.where(F.col(c).isNull()).count() == 0
    steps = quality.time_gaps(clean, 3600, TL)
    assert steps.agg(F.max("longest_step_seconds")).first()[0] == 3600
    assert clean.agg(F.max("pm25")).first()[0] < 800
    assert out.outliers.where("variable = 'pm25'").agg(F.sum("treated")).first()[0] > 0
    assert all(0 <= r["overall"] <= 100 for r in out.scores.collect())
    assert out.split.select("split").distinct().count() == 3


def test_transform_reuses_what_fit_learned(spark):
    s = Settings(axis="time", min_valid=0.4, timeline=TL)
    valid = schema_ops.validate(raw_hourly(spark, n=200))
    _, state = fit_clean(valid, s)
    later = valid.withColumn("no2", F.lit(None).cast("double"))
    again = transform_clean(later, state, s)
    assert "no2" in again.columns
    medians = {r["station"]: r["median"] for r in state.medians.where("variable = 'no2'").collect()}
    for r in again.groupBy("station").agg(F.min("no2").alias("a"), F.max("no2").alias("b")).collect():
        assert r["a"] == r["b"] == pytest.approx(medians[r["station"]])


def test_interpolation_matches_pandas(spark):
    pdf = irregular()
    df = to_spark(spark, pdf, IRREGULAR)
    got = fill.interpolate(df, ["x"], "time", TL).orderBy("station", "date").toPandas()
    for station, part in pdf.groupby("station"):
        series = part.set_index("date")["x"].interpolate("time", limit_direction="both")
        mine = got[got.station == station].x.to_numpy()
        np.testing.assert_allclose(mine, series.to_numpy(), rtol=1e-9)
    by_row = fill.interpolate(df, ["x"], "row", TL).orderBy("station", "date").toPandas()
    for station, part in pdf.groupby("station"):
        series = part["x"].interpolate("linear", limit_direction="both")
        np.testing.assert_allclose(by_row[by_row.station == station].x.to_numpy(), series.to_numpy(), rtol=1e-9)


def test_unknown_options_raise(spark):
    df = to_spark(spark, irregular(), IRREGULAR)
    with pytest.raises(ValueError, match="strategy"):
        fill.impute(df, ["x"], "guess")
    with pytest.raises(ValueError, match="method"):
        fences.learn(df, ["x"], "magic")
    with pytest.raises(ValueError, match="treatment"):
        fences.apply(df, fences.learn(df, ["x"], "zscore"), ["x"], "hide")


def test_many_copies_of_one_key(spark):
    """One key holds almost all rows; the first source still wins and nothing else is lost."""
    copies = spark.range(60_000).select(
        F.lit("hot").alias("station"),
        F.lit(START).cast("timestamp_ntz").alias("date"),
        (F.col("id") + 5).alias("rank"),
        F.col("id").cast("double").alias("x"),
    )
    rest = spark.range(10).select(
        F.concat(F.lit("s"), "id").alias("station"),
        F.lit(START).cast("timestamp_ntz").alias("date"),
        F.lit(1).cast("bigint").alias("rank"),
        F.lit(7.0).alias("x"),
    )
    out = dedupe.keep_first(copies.unionByName(rest), ["rank"])
    assert out.count() == 11
    assert out.where("station = 'hot'").first()["x"] == 0.0


def test_longest_null_run_across_segments(spark):
    at = [START + dt.timedelta(days=i) for i in range(90)]
    values = [None] * 90
    values[3] = values[70] = 1.0
    rows = [("a", t, v, None) for t, v in zip(at, values, strict=True)]
    df = spark.createDataFrame(rows, IRREGULAR)
    got = {r["variable"]: r["longest_run"] for r in quality.longest_null_runs(df, ["x", "y"], Timeline(rows=7)).collect()}
    assert got == {"x": 66, "y": 90}


def test_resample_keeps_stations_apart(spark):
    df = to_spark(spark, irregular(), IRREGULAR)
    got = grid.resample(df, ["x"], "HOUR").toPandas()
    pdf = irregular()
    for station, part in pdf.groupby("station"):
        expected = part.set_index("date")["x"].resample("1h").mean()
        mine = got[got.station == station].sort_values("date")
        assert list(pd.to_datetime(mine.date)) == list(expected.index)
        np.testing.assert_allclose(mine.x.to_numpy(dtype=float), expected.to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("method", ["iqr", "zscore", "modified_zscore"])
def test_fences_match_pandas(spark, method):
    pdf = irregular(sizes={"hot": 300, "mid": 60})
    pdf["humidity"] = pdf.x - 30
    df = to_spark(spark, pdf.assign(y=pdf.humidity), IRREGULAR).withColumnRenamed("y", "humidity")
    got = {(r["station"], r["variable"]): r for r in fences.learn(df, ["x", "humidity"], method, 2.0).collect()}
    for station, part in pdf.groupby("station"):
        for c in ("x", "humidity"):
            s = part[c].dropna()
            q1, q3 = s.quantile([0.25, 0.75])
            if method == "iqr":
                lo, hi = q1 - 2 * (q3 - q1), q3 + 2 * (q3 - q1)
            elif method == "zscore":
                lo, hi = s.mean() - 2 * s.std(), s.mean() + 2 * s.std()
            else:
                half = 2 * 1.167 * (s - s.median()).abs().median() / 0.6745
                lo, hi = s.median() - half, s.median() + half
            if c == "humidity":
                lo, hi = max(lo, 0.0), min(hi, 100.0)
            r = got[(station, c)]
            assert (r["lower"], r["upper"]) == (pytest.approx(lo), pytest.approx(hi))


def test_few_values_get_no_fence(spark):
    df = to_spark(spark, irregular(sizes={"sparse": 9}), IRREGULAR)
    assert fences.learn(df, ["y"]).count() == 0
    assert fences.apply(df, fences.learn(df, ["y"]), ["y"]).exceptAll(df).count() == 0


def test_gap_split_is_ordered_and_disjoint(spark):
    df = to_spark(spark, irregular(sizes={"hot": 700, "mid": 200}), IRREGULAR)
    out = splits.gap_split(df, timeline=TL).toPandas()
    for station, n in (("hot", 700), ("mid", 200)):
        part = out[out.station == station]
        sizes = part.split.value_counts()
        assert sizes["test"] == int(n * 0.15)
        assert sizes["val"] == int(n * 0.10)
        assert sizes["train"] == n - sizes["test"] - sizes["val"] - 48
        ends = part.groupby("split").date.agg(["min", "max"])
        assert ends.loc["train", "max"] < ends.loc["val", "min"] < ends.loc["val", "max"] < ends.loc["test", "min"]


def test_too_short_station_raises(spark):
    df = to_spark(spark, irregular(sizes={"sparse": 9}), IRREGULAR)
    with pytest.raises(Exception, match="too short"):
        splits.gap_split(df).collect()
