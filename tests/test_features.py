from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from breezeframe.core.timeline import Timeline
from breezeframe.functions import air
from breezeframe.operators import asof, history, spatial
from breezeframe.plans import features

from .frames import DAILY, IRREGULAR, START, daily_series, irregular, to_spark

TL = Timeline(rows=25)


@pytest.fixture(scope="module")
def table(spark):
    df = to_spark(spark, daily_series(), DAILY)
    return features.build_features(df, {"s0": 0}, "2023-03-01", "2023-03-31", timeline=TL).cache()


def test_column_families(table):
    counts = {r["family"]: r["count"] for r in features.inventory(table).groupBy("family").count().collect()}
    assert counts == {
        "raw_pollutants": 11, "lag": 66, "rolling": 104, "interaction": 12, "station": 12,
        "temporal_cyclical": 8, "temporal_season_ohe": 5, "temporal_events": 6, "temporal_calendar": 7,
    }
    assert set(features.MODEL_FEATURES) <= set(table.columns)
    assert len(features.MODEL_FEATURES) == 59 and len(features.SEQUENCE_FEATURES) == 41


def test_warm_up_and_codes(table):
    assert table.count() == 2 * (120 - 30)
    codes = {r["station"]: r["station_encoded"] for r in table.select("station", "station_encoded").distinct().collect()}
    assert codes == {"s0": 0, "s1": -1}


def test_rolling_matches_pandas(table):
    got = table.orderBy("station", "date").toPandas()
    pdf = daily_series()
    for station, part in pdf.groupby("station"):
        shifted = part.aqi.shift(1)
        mine = got[got.station == station]
        keep = part.index[30:]
        for n in (3, 7, 14, 30):
            r = shifted.rolling(n, min_periods=1)
            np.testing.assert_allclose(mine[f"roll_mean_aqi_{n}"], r.mean()[keep], rtol=1e-9)
            np.testing.assert_allclose(mine[f"roll_median_aqi_{n}"], r.median()[keep], rtol=1e-9)
            np.testing.assert_allclose(mine[f"roll_std_aqi_{n}"], r.std()[keep], rtol=1e-7)
        slope = shifted.rolling(7).apply(lambda v: np.polyfit(np.arange(7), v, 1)[0], raw=True)
        np.testing.assert_allclose(mine.roll_trend_aqi_7, slope[keep], rtol=1e-6, atol=1e-9)


def test_no_look_ahead(spark, table):
    """Changing the target on one day must not change that day's look-back features."""
    pdf = daily_series()
    hit = pdf.station.eq("s0") & pdf.date.eq(pdf.date[60])
    pdf.loc[hit, "aqi"] += 100
    again = features.build_features(
        to_spark(spark, pdf, DAILY), {"s0": 0}, "2023-02-01", "2023-03-31", timeline=TL
    )
    names = [c for c in table.columns if c.startswith(("lag_", "roll_"))]
    day = pdf.date[60]

    def pick(df):
        return df.where((F.col("station") == "s0") & (F.col("date") == F.lit(day))).select(names).first()

    assert pick(table) == pick(again)


def test_sequences_never_cross_stations(spark):
    df = to_spark(spark, daily_series(days=40), DAILY)
    out = history.sequences(df, ["aqi", "pm25"], length=14, horizon=3, timeline=TL)
    per = {r["station"]: r["count"] for r in out.groupBy("station").count().collect()}
    assert per == {"s0": 40 - 14 - 3 + 1, "s1": 40 - 14 - 3 + 1}
    pdf = daily_series(days=40)
    part = pdf[pdf.station == "s1"].reset_index(drop=True)
    row = out.where(F.col("station") == "s1").orderBy("date").first()
    np.testing.assert_allclose(np.array(row["sequence"]), part.loc[:13, ["aqi", "pm25"]].to_numpy())
    assert row["target"] == pytest.approx(part.aqi[16])


def test_class_edges(spark):
    values = [0.0, 50.0, 50.5, 100.0, 200.0, 300.0, 400.0, 400.01, 500.0, 501.0, -1.0, 502.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(air.aqi_class(F.col("v"))).collect()]
    assert got == [0, 0, 1, 1, 2, 3, 4, 5, 5, 5, None, None, None]


def test_nearest_reading_by_brute_force(spark):
    pdf = irregular(sizes={"hot": 90, "mid": 40})
    readings = to_spark(spark, pdf, IRREGULAR)
    probes = pdf.copy()
    probes["date"] = probes.date + np.where(np.arange(len(pdf)) % 3 == 0, np.timedelta64(0), np.timedelta64(301, "s"))
    p = to_spark(spark, probes, IRREGULAR).select("station", "date", F.col("y").alias("probe"))
    many = p.unionByName(p.limit(1).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("_r"))
    got = asof.nearest(many, readings, ["y"], timeline=Timeline(rows=10)).toPandas()
    assert len(got) == len(probes) + 500
    for r in got.drop_duplicates(["station", "date"]).itertuples():
        part = pdf[pdf.station == r.station]
        best = part.loc[(part.date - r.date).abs().idxmin()]
        assert best.date == r.matched_date and best.y == pytest.approx(r.y)


def test_last_rows_before_by_brute_force(spark):
    pdf = irregular(sizes={"hot": 60, "mid": 30})
    df = to_spark(spark, pdf, IRREGULAR)
    got = asof.last_before(df.select("station", "date"), df, 7, ["y"], timeline=Timeline(rows=9)).toPandas()
    for (station, at), rows in got.groupby(["station", "date"]):
        part = pdf[pdf.station == station]
        prior = part[part.date < at].tail(7)
        if len(prior) < 7:
            prior = part.tail(7)
        assert list(rows.sort_values("back", ascending=False).y) == pytest.approx(list(prior.y))


def test_distance_weights(spark):
    anchors = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 3.0)], "station string, lat double, lon double")
    targets = spark.createDataFrame([("on", 0.0, 3.0), ("near", 0.0, 1.0)], "target string, lat double, lon double")
    w = {(r["target"], r["station"]): r["weight"] for r in spatial.station_weights(targets, anchors).collect()}
    assert w[("on", "b")] == 1.0 and w[("on", "a")] == 0.0
    assert w[("near", "a")] == pytest.approx(0.8)


def test_calendar_query_reads_all_stations(spark, sf):
    import __spark_entry__ as entry
    from breezeframe.operators import spine
    from checks import inputs

    daily = inputs.daily(spark, sf)
    got = entry.queries()["j7_calendar_all_stations"](spark, sf)
    assert got.where("origin = 'actual'").count() == daily.where("aqi is not null").select("date").distinct().count()
    one = daily.where("month(date) = 3 and dayofmonth(date) = 1")
    part = {r.origin: r.n for r in spine.year_calendar(one, spark.createDataFrame([(2400,)], "year int")).groupBy("origin").agg({"*": "count"}).toDF("origin", "n").collect()}
    assert part == {"climatology": 1, "default": 365}


def test_distance_weights_in_blocks_equal_all_pairs(spark):
    """Many blocks of few anchors, two anchors at one place, a target on them, targets listed twice."""
    import random

    rng = random.Random(3)
    places = [(f"a{k}", rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(60)] + [("twin", 1.0, 2.0), ("twin2", 1.0, 2.0)]
    wanted = [(f"t{k}", rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(9)] + [("on", 1.0, 2.0)]
    anchors = spark.createDataFrame(places, "station string, lat double, lon double")
    targets = spark.createDataFrame([*wanted, wanted[0]], "target string, lat double, lon double")
    got = {(r["target"], r["station"]): r["weight"] for r in spatial.station_weights(targets, anchors, block=7).collect()}
    for t, lat, lon in wanted:
        d2 = {s: (lat - a) ** 2 + (lon - b) ** 2 for s, a, b in places}
        raw = {s: float(v == 0) if 0.0 in d2.values() else 1 / v for s, v in d2.items()}
        assert all(abs(got[t, s] - w / sum(raw.values())) < 1e-12 for s, w in raw.items())
    assert len(got) == len(wanted) * len(places)
    assert spatial.station_weights(targets, anchors.limit(0)).count() == 0


@pytest.mark.parametrize(("slots", "sizes"), [(8, 5), (8, 60), (3, 8)])
def test_blend_equals_all_pairs(spark, slots, sizes):
    """One set of anchors and many; weights and readings that come twice, gaps, moments without anchors, null keys."""
    import random

    rng = random.Random(sizes)
    weights = [(f"t{t}", f"a{a}", rng.choice([0.0, rng.random()])) for t in range(7) for a in range(sizes)] + [("t0", "a1", 0.5), (None, "a2", 0.25), ("t9", None, 1.0), ("alone", "gone", 1.0)]
    readings = [(f"a{a}", d, rng.choice([None, rng.random()]), rng.random()) for d in range(4) for a in range(sizes)] + [("a1", 2, 0.5, None), ("a2", None, 3.0, None), ("other", 77, 1.0, 1.0), (None, 3, 1.0, 1.0), ("a1", 88, None, 2.0)]
    w = spark.createDataFrame(weights, "target string, station string, weight double")
    r = spark.createDataFrame(readings, "station string, date int, x double, y double")
    want = {}
    for t, a, g in weights:
        for s, d, x, y in readings:
            if g > 0 and a is not None and a == s:
                found = want.setdefault((t, d), [0.0] * 4)
                for k, v in ((0, x), (2, y)):
                    found[k] += g * (v or 0.0)
                    found[k + 1] += g * (v is not None)
    got = [tuple(v) for v in spatial.blend(w, r, ["x", "y"], slots=slots).collect()]
    assert len(got) == len(want) and {v[:2] for v in got} == set(want)
    for t, d, x, y in got:
        sx, nx, sy, ny = want[t, d]
        assert (x, y) == (pytest.approx(sx / nx) if nx else None, pytest.approx(sy / ny) if ny else None)
    assert spatial.blend(w.limit(0), r, ["x", "y"]).count() == 0


def test_blend_does_not_multiply_by_anchors(spark):
    """Every target meets every moment once, not once for each anchor."""
    w = spark.range(3000).selectExpr("concat('t', id div 5) as target", "concat('a', id % 5) as station", "0.5 as weight")
    r = spark.range(500).selectExpr("concat('a', id % 5) as station", "cast(id div 5 as int) as date", "cast(id as double) as x")
    plan = spatial.blend(w, r, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan


def test_last_rows_by_either_way(spark):
    df = spark.createDataFrame([(f"s{k % 3}", START + dt.timedelta(hours=k), float(k)) for k in range(300)], "station string, date timestamp_ntz, x double")
    few, many = (history.last_numbered(df, 5, TL), history.last_numbered(df, history.GROUP_LIMIT + 1, TL))
    assert sorted(r["x"] for r in few.collect()) == [float(k) for k in range(285, 300)]
    assert many.count() == 300 and {(r["x"], r["_back"]) for r in many.where("_back <= 5").collect()} == {(r["x"], r["_back"]) for r in few.collect()}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
