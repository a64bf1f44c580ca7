from __future__ import annotations

import datetime as dt
from functools import partial

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from breezeframe.core.timeline import Timeline
from breezeframe.functions.numeric import correlation, slope
from breezeframe.operators import attribution, explore
from breezeframe.operators.scores import overfit_gap, rank_models, regression_scores
from breezeframe.plans import explain, scenario, training
from breezeframe.sources.writers import load_model, save_model

from .frames import DAILY, START, daily_series, to_spark

X = ["pm25", "pm10", "no2", "temperature"]


@pytest.fixture(scope="module")
def rows(spark):
    return to_spark(spark, daily_series(), DAILY).withColumn("split", F.lit("train")).cache()


def predictions(spark, y, p, model="m"):
    data = [(model, "test", "s", float(a), float(b)) for a, b in zip(y, p, strict=True)]
    return spark.createDataFrame(data, "model string, split string, station string, aqi double, prediction double")


def test_known_scores(spark):
    df = predictions(spark, [100, 150, 200, 250, 300], [110, 140, 210, 240, 310])
    r = regression_scores(df).where("station = 'Combined'").first()
    assert r["rmse"] == pytest.approx(10) and r["mae"] == pytest.approx(10)
    assert r["mape"] == pytest.approx(np.mean([10 / v for v in (100, 150, 200, 250, 300)]) * 100)
    assert r["r2"] == pytest.approx(1 - 500 / 25_000)


def test_score_edges(spark):
    flat = regression_scores(predictions(spark, [5, 5, 5], [5, 5, 5])).first()
    assert flat["r2"] == 1.0
    off = regression_scores(predictions(spark, [5, 5, 5], [6, 6, 6])).first()
    assert off["r2"] == 0.0
    mean = regression_scores(predictions(spark, [1, 2, 3], [2, 2, 2])).first()
    assert mean["r2"] == pytest.approx(0.0)
    zero = regression_scores(predictions(spark, [0, 10], [1, 10])).first()
    assert np.isfinite(zero["mape"]) and 0 <= zero["smape"] <= 200


def test_ranking_and_gap(spark):
    a = predictions(spark, [1, 2, 3], [1, 2, 4], "close").unionByName(predictions(spark, [1, 2, 3], [4, 4, 4], "far"))
    both = a.unionByName(a.withColumn("split", F.lit("train"))).unionByName(a.withColumn("split", F.lit("val")))
    scores = regression_scores(both)
    best = rank_models(scores).where("rank = 1 AND station = 'Combined'").select("model").distinct().collect()
    assert [r["model"] for r in best] == ["close"]
    assert all(r["overfit_gap"] == pytest.approx(0) for r in overfit_gap(scores).collect())


def standardised(pdf):
    z = pdf[X].to_numpy()
    return (z - z.mean(0)) / z.std(0), pdf.aqi.to_numpy()


def test_ridge_equals_closed_form(rows):
    z, y = standardised(daily_series())
    w = np.linalg.solve(z.T @ z + 50.0 * np.eye(len(X)), z.T @ (y - y.mean()))
    model = training.ridge_model(rows, X, 50.0)
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), w, rtol=1e-6)


def test_elastic_net_equals_coordinate_descent(rows):
    z, y = standardised(daily_series())
    alpha, ratio, w, yc = 0.8, 0.4, np.zeros(len(X)), y - y.mean()
    for _ in range(3_000):
        for j in range(len(X)):
            rest = yc - z @ w + z[:, j] * w[j]
            c = z[:, j] @ rest / len(y)
            w[j] = np.sign(c) * max(abs(c) - alpha * ratio, 0) / (1 + alpha * (1 - ratio))
    model = training.elastic_model(rows, X, alpha, ratio)
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), w, rtol=1e-3, atol=1e-4)


def test_alpha_search_picks_the_lowest_score(rows):
    alpha, _, trace = training.tune_ridge(rows, rows, X, (0.01, 10.0, 5_000.0))
    assert alpha == min(trace, key=lambda t: t[1])[0] == 0.01


def test_trees_and_importance(rows, tmp_path):
    for model in (
        training.tree_model(rows, X, 4),
        training.forest_model(rows, X, numTrees=5, maxDepth=4),
        training.boosting_model(rows, X, maxIter=3),
        training.histogram_model(rows, X, maxIter=3),
    ):
        listed = training.importance(model, X, rows)
        assert listed.agg(F.sum("importance")).first()[0] == pytest.approx(100)
        assert training.rmse_of(model, rows) < 70
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    assert training.rmse_of(again, rows) == pytest.approx(training.rmse_of(model, rows))


def test_permutation_importance(rows):
    df = rows.withColumn("constant", F.lit(3.0))
    model = training.linear_model(df, [*X, "constant"])
    got = {r["feature"]: r for r in training.permutation_importance(model, df, [*X, "constant"], repeats=5).collect()}
    assert got["constant"]["importance_mean"] == pytest.approx(0, abs=1e-9)
    assert got["pm10"]["importance_mean"] > got["no2"]["importance_mean"]
    assert got["pm10"]["importance_mean"] > 0.05


def test_boosting_stops_at_the_best_round(rows):
    """The kept round is the best of all prefixes, each scored from its own trees; a longer fit begins with a shorter one."""
    over = {"stepSize": 0.6, "maxDepth": 3, "maxIter": 24}
    stopped = training.stopped_boosting(rows, X, patience=4, first=5, **over)
    assert training.best_round([5, 4, 4, 3, 9, 9, 1], 2) == (4, True) and training.best_round([5, 4], 2) == (2, False)
    assert 1 <= stopped.rounds <= len(stopped.curve) <= 24
    full = training.stopped_boosting(rows, X, patience=10**6, first=24, **over)
    held = rows.where(training.held_out()).select(*X, "aqi").toPandas()
    assert np.allclose(full.curve[: len(stopped.curve)], stopped.curve)
    errors = []
    for k in range(1, len(full.curve) + 1):
        cut = training.first_trees(full.model.stages[1], k) if k <= full.rounds else None
        if cut is None:
            break
        assert cut.getNumTrees == k
        predicted = PipelineModel([full.model.stages[0], cut]).transform(rows.where(training.held_out())).select("prediction").toPandas()["prediction"]
        errors.append(((held["aqi"] - predicted) ** 2).mean())
    assert np.allclose(errors, full.curve[: len(errors)])
    assert full.rounds == int(np.argmin(full.curve)) + 1
    want, turned = training.best_round(full.curve, 4)
    assert stopped.rounds == want and (turned or len(stopped.curve) == 24)


def test_permutation_importance_equals_brute_force(spark):
    """One donor for each row and repeat, for all features alike."""
    rng = np.random.default_rng(3)
    data = [("s", START + dt.timedelta(days=k), *map(float, rng.normal(size=2)), float(rng.normal())) for k in range(40)]
    df = spark.createDataFrame(data, "station string, date timestamp_ntz, a double, b double, aqi double")
    model = training.linear_model(df, ["a", "b"])
    got = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in training.permutation_importance(model, df, ["a", "b"], repeats=3).collect()}
    from math import gcd
    from random import Random

    base = training._hash_numbered(df, training.SEED).orderBy("_pos").toPandas()
    x, y, n = base[["a", "b"]].to_numpy(), base["aqi"].to_numpy(), len(base)
    coef, at, scale = model.stages[2].coefficients.toArray(), model.stages[1].mean.toArray(), model.stages[1].std.toArray()
    sse = lambda v: ((y - ((v - at) / scale @ coef + model.stages[2].intercept)) ** 2).sum()
    draws, lost = Random(training.SEED), {"a": [], "b": []}
    for _ in range(3):
        a = draws.randrange(1, n)
        while gcd(a, n) != 1:
            a = draws.randrange(1, n)
        partner = (a * np.arange(n) + draws.randrange(n)) % n
        for j, name in enumerate("ab"):
            swapped = x.copy()
            swapped[:, j] = x[partner, j]
            lost[name].append((sse(swapped) - sse(x)) / ((y - y.mean()) ** 2).sum())
    for name, drops in lost.items():
        assert got[name] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-9)


def test_hash_numbering_with_many_buckets(spark):
    df = spark.range(3_000).select(F.lit("s").alias("station"), F.col("id").alias("date"))
    got = [r["_pos"] for r in training._hash_numbered(df, 1, bucket_rows=20).collect()]
    assert sorted(got) == list(range(3_000))
    order = training._hash_numbered(df, 1).select("date", "_pos").collect()
    assert {(r["date"], r["_pos"]) for r in order} == {(r["date"], r["_pos"]) for r in training._hash_numbered(df, 1, bucket_rows=20).select("date", "_pos").collect()}


def test_hash_numbering_is_a_bijection(rows):
    numbered = training._hash_numbered(rows.select("station", "date"), 1)
    positions = sorted(r["_pos"] for r in numbered.select("_pos").collect())
    assert positions == list(range(240))


def test_coalition_attribution_is_efficient_and_exact_for_linear_models(rows):
    model = training.linear_model(rows, X)
    phi = explain.coalition_attribution(model, rows, rows, X, coalitions=64).toPandas()
    total = phi.groupby(["station", "date"]).agg(s=("phi", "sum"), f=("prediction", "first"), b=("base", "first"))
    np.testing.assert_allclose(total.s, total.f - total.b, atol=1e-6)
    pdf = daily_series()
    w = model.stages[-1].coefficients.toArray() / pdf[X].std(ddof=1).to_numpy()
    merged = phi.merge(pdf.melt(["station", "date"], X, "feature", "x"), on=["station", "date", "feature"])
    centre, slope = pdf[X].mean(), dict(zip(X, w, strict=True))
    expected = [slope[f] * (x - centre[f]) for f, x in zip(merged.feature, merged.x, strict=True)]
    np.testing.assert_allclose(merged.phi, expected, rtol=1e-3, atol=1e-3)


def test_constant_feature_gets_no_attribution(rows):
    df = rows.withColumn("constant", F.lit(3.0))
    model = training.linear_model(df, [*X, "constant"])
    phi = explain.coalition_attribution(model, df, df, [*X, "constant"], coalitions=64)
    worst = phi.where("feature = 'constant'").agg(F.max(F.abs("phi"))).first()[0]
    assert worst == pytest.approx(0, abs=1e-4)


def test_occlusion_sums_to_the_difference(rows):
    model = training.tree_model(rows, X, 5)
    phi = explain.occlusion_attribution(model, rows, rows, X, ["pm25", "pm10"])
    sums = phi.groupBy("station", "date").agg(
        F.sum("phi").alias("s"), F.first("prediction").alias("f"), F.first("base").alias("b")
    )
    assert sums.where("abs(s - (f - b)) > 1e-6").count() == 0


def test_waterfall_keeps_the_total(spark):
    data = [("r", f"f{i}", float(v)) for i, v in enumerate([5, -4, 3, -2, 1])]
    df = spark.createDataFrame(data, "row string, feature string, phi double")
    out = attribution.waterfall(df, ["row"], 2)
    assert {r["feature"]: r["phi"] for r in out.collect()} == {"f0": 5.0, "f1": -4.0, "other": 2.0}


LOOKBACK = ["lag_aqi_1", "lag_aqi_7", "roll_mean_aqi_7", "roll_std_aqi_7", "roll_trend_aqi_7", "pm25", "lag_pm25_1"]


def test_block_forecast_equals_step_by_step(spark):
    """The four passes against 73 dependent steps computed one after the other, with gaps in the days."""
    pdf = daily_series(stations=1, days=70)
    pdf = pdf.drop(index=[20, 21, 41, 50, 51, 52]).reset_index(drop=True)
    df = to_spark(spark, pdf, DAILY)
    rng = np.random.default_rng(0)
    train = spark.createDataFrame(
        [tuple(float(v) for v in rng.normal(size=len(LOOKBACK) + 1)) for _ in range(40)],
        ", ".join(f"{c} double" for c in [*LOOKBACK, "aqi"]),
    )
    assembler = VectorAssembler(inputCols=LOOKBACK, outputCol="v")
    model = Pipeline(stages=[assembler, LinearRegression(featuresCol="v", labelCol="aqi")]).fit(train)
    lr = model.stages[-1]
    starts = [START + dt.timedelta(days=45, hours=h) for h in (0, 12, 13)] + [START + dt.timedelta(days=69, hours=5)]
    requests = spark.createDataFrame(
        [(f"r{i}", "s0", t, 90.0 if i == 1 else None) for i, t in enumerate(starts)],
        "request string, station string, at timestamp_ntz, o_pm25 double",
    )
    got = scenario.forecast_hours(requests, df, model, Timeline(rows=20)).toPandas()
    days = [dt.datetime.combine(d, dt.time()) for d in pdf.date]

    def nearest(t):
        return min(range(len(days)), key=lambda i: (abs(days[i] - t), days[i]))

    for i, t0 in enumerate(starts):
        base = pdf.pm25[nearest(t0)]
        delta = (90.0 - base) if i == 1 else 0.0
        done = {}
        for h in range(73):
            now = t0 + dt.timedelta(hours=h)

            def aqi(k, now=now, t0=t0, done=done):
                at = now - dt.timedelta(days=k)
                return done[at] if at >= t0 else pdf.aqi[nearest(at)]

            def pm(k, now=now, t0=t0, delta=delta):
                at = now - dt.timedelta(days=k)
                raw = pdf.pm25[nearest(at)]
                return max(1.0, raw + delta) if at >= t0 else raw

            week = np.array([aqi(k) for k in range(7, 0, -1)])
            x = [
                aqi(1), aqi(7), week.mean(), week.std(ddof=1), np.polyfit(np.arange(7), week, 1)[0], pm(0), pm(1),
            ]
            done[now] = max(0.0, float(np.dot(lr.coefficients.toArray(), x) + lr.intercept))
        mine = got[got.request == f"r{i}"].sort_values("hours")
        assert list(mine.hours) == list(range(73))
        np.testing.assert_allclose(mine.prediction, list(done.values()), rtol=1e-8, atol=1e-8)


def test_forecasts_between_stations_and_odd_requests(spark):
    """Places are blended from the nearest readings of all anchors; every request row gets its own 73 answers."""
    days = {"a": range(0, 50), "b": [d for d in range(5, 60) if d % 7], "c": range(20, 30)}
    where = {"a": (0.0, 0.0), "b": (3.0, 0.0), "c": (0.0, 4.0), "silent": (1.0, 1.0)}
    value = {(s, d): float(100 + 37 * d % 91 + 10 * k) for k, s in enumerate("abc") for d in days[s]}
    readings = spark.createDataFrame([(s, (START + dt.timedelta(days=d)).date(), v) for (s, d), v in value.items()], "station string, date date, aqi double")
    anchors = spark.createDataFrame([(s, *p) for s, p in where.items()], "station string, lat double, lon double")
    train = spark.createDataFrame([(float(v), 10.0 + 0.5 * v) for v in (1, 5, 9)], "lag_aqi_1 double, aqi double")
    model = training.linear_model(train, ["lag_aqi_1"])
    at = {"in": 40.25, "out": 4_000.0, "far": -4_000.5, "noon": 25.5}
    asked = [
        ("in", None, at["in"], 1.0, 1.0), ("on", "nobody", at["in"], 3.0, 0.0), ("out", "x", at["out"], 1.0, 1.0), ("far", None, at["far"], 2.0, 2.0),
        ("noon", None, at["noon"], 1.0, 2.5), ("own", "b", at["noon"], 1.0, 1.0), ("twice", "a", at["in"], None, None), ("twice", "a", at["noon"], None, None),
        ("lost", "x", at["in"], None, 1.0), ("timeless", "a", None, 1.0, 1.0), (None, None, None, None, None),
    ]
    moment = lambda d: None if d is None else START + dt.timedelta(days=d)
    requests = spark.createDataFrame([(r, s, moment(d), lat, lon) for r, s, d, lat, lon in asked], "request string, station string, at timestamp_ntz, lat double, lon double")
    got = scenario.forecast_hours(requests, readings, model, Timeline(rows=20), anchors=anchors).toPandas()
    assert len(got) == 73 * len(asked)

    def nearest(s, day):
        return value[s, min(days[s], key=lambda d: (abs(d - day), d))]

    def looked_up(station, lat, lon, day):
        if station in days:
            return nearest(station, day)
        d2 = {s: (lat - where[s][0]) ** 2 + (lon - where[s][1]) ** 2 for s in days}
        raw = {s: float(v == 0) if 0.0 in d2.values() else 1 / v for s, v in d2.items()}
        return sum(w * nearest(s, day) for s, w in raw.items()) / sum(raw.values())

    answered = {}
    for row in got.itertuples():
        answered.setdefault((row.request, row.at), {})[row.hours] = row.prediction
    for r, s, d, lat, lon in asked:
        found = next(v for k, v in answered.items() if (k[0] == r or (r is None and not isinstance(k[0], str))) and (d is None or k[1] == moment(d)))
        assert sorted(found) == list(range(73))
        if d is None or (s not in days and (lat is None or lon is None)):
            assert all(np.isnan(v) for v in found.values())
            continue
        done = {}
        for h in range(73):
            done[h] = 10.0 + 0.5 * (done[h - 24] if h >= 24 else looked_up(s, lat, lon, d + h / 24 - 1))
            assert found[h] == pytest.approx(done[h], abs=1e-6)
    nobody = scenario.forecast_hours(requests.where("request = 'in'"), readings, model, anchors=anchors.where("station = 'silent'"))
    assert nobody.count() == 73 and nobody.where("prediction IS NOT NULL").count() == 0


def test_read_out(spark):
    hourly = spark.createDataFrame([("r", "s", h, 5.0 + h) for h in range(73)], "request string, station string, hours int, prediction double")
    out = scenario.read_out(hourly).orderBy("hours").collect()
    assert [r["horizon"] for r in out] == ["+1 hours", "+3 hours", "+6 hours", "+12 hours", "+1 days", "+2 days", "+3 days"]
    assert out[0]["lower"] == 0.0


def test_what_if_feeds_predictions_back(spark):
    feats = ["lag_aqi_1", "pm25"]
    train = spark.createDataFrame([(100.0, 1.0, 90.0, 1.0), (200.0, 2.0, 190.0, 2.0), (300.0, 5.0, 250.0, 2.5)], "lag_aqi_1 double, pm25 double, aqi double, lag_aqi_7 double")
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="v"), LinearRegression(featuresCol="v", labelCol="aqi")]).fit(train)
    lr = model.stages[-1]
    df = spark.createDataFrame([("a", START, 3.0, 150.0)], "scenario string, at timestamp_ntz, pm25 double, lag_aqi_1 double")
    got = [r["aqi"] for r in scenario.what_if_steps(df, model, feats, train, steps=5, cut_every=2).orderBy("hours").collect()]
    lag, expected = 150.0, []
    for _ in range(5):
        lag = float(np.clip(round(lr.coefficients[0] * lag + lr.coefficients[1] * 3.0 + lr.intercept, 1), 15, 500))
        expected.append(int(lag))
    assert got == expected


def test_boosting_stops_on_given_rows(spark):
    """Rows marked as held out, and only these, choose the round; an unknown mark counts as a training row."""
    rows = [(k, float(k % 7), float(k % 5), float(3 * (k % 7) + (k * 37) % 11)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, aqi double")
    held = F.when(F.col("k") % 10 == 0, F.lit(True)).when(F.col("k") % 2 == 0, F.lit(False))
    stopped = training.stopped_boosting(df, ["a", "b"], held=held, maxIter=4, first=2, maxDepth=2, stepSize=0.5)
    assert len(stopped.curve) == 4 and stopped.rounds == 1 + min(range(4), key=lambda i: (stopped.curve[i], i))
    out = stopped.model.transform(df.where("k % 10 = 0")).agg(F.avg((F.col("aqi") - F.col("prediction")) ** 2).alias("e")).first()["e"]
    assert abs(out - stopped.curve[stopped.rounds - 1]) < 1e-9


def test_correlation_of_constant_columns(spark):
    """A constant side gives NaN in a division that would fail; one pair and none give null."""
    data = [("flat", 5.0, float(k), float(k * k)) for k in range(12)] + [("one", 1.0, 2.0, 3.0), ("one", None, 2.0, 3.0), ("none", None, 1.0, 2.0)]
    data += [("flat in pairs", 5.0, 1.0, 1.0), ("flat in pairs", 5.0, 2.0, 2.0), ("flat in pairs", 6.0, None, 3.0)]
    df = spark.createDataFrame(data, "station string, x double, y double, z double")
    got = {r["station"]: r for r in df.groupBy("station").agg(correlation("x", "y").alias("r"), correlation("y", "z").alias("s"), slope("y", "x").alias("a")).collect()}
    flat = [r for r in data if r[0] == "flat"]
    assert np.isnan(got["flat"]["r"]) and np.isnan(got["flat"]["a"])
    assert got["flat"]["s"] == pytest.approx(np.corrcoef([r[2] for r in flat], [r[3] for r in flat])[0, 1])
    assert np.isnan(got["flat in pairs"]["r"]) and np.isnan(got["flat in pairs"]["a"]) and got["flat in pairs"]["s"] == pytest.approx(1.0)
    assert [got[s][c] for s in ("one", "none") for c in ("r", "a")] == [None] * 4
    flat_rows = df.where("station = 'flat'")
    matrix = {(r["x"], r["y"]): r["r"] for r in explore.pearson(flat_rows, ["x", "y", "z"], by_station=True).collect()}
    assert np.isnan(matrix["x", "y"]) and matrix["y", "z"] == pytest.approx(got["flat"]["s"]) and matrix["x", "x"] == 1.0
    assert np.isnan(explore.correlations(flat_rows, ["x"], "y").first()["pearson_r"])


def test_constant_columns_in_several_tasks(spark):
    """Variances merged from many tasks miss zero by rounding; the column is constant all the same."""
    flat = [50 * 1000 / 1033.0, 200 / 1049.0, 0.1, 1 / 3, 1e8 / 3, 1.1]
    columns = ", ".join(f"CAST({v!r} AS DOUBLE) AS x{i}" for i, v in enumerate(flat))
    df = spark.range(0, 1237, 1, 13).selectExpr("CAST(id % 101 AS DOUBLE) AS y", *columns.split(", "))
    names = [f"x{i}" for i in range(len(flat))]
    row = df.agg(*(F.var_pop(c).alias(f"v_{c}") for c in names), *(correlation("y", c).alias(f"r_{c}") for c in names), *(correlation(c, "y").alias(f"s_{c}") for c in names), *(slope("y", c).alias(f"a_{c}") for c in names)).first()
    assert any(row[f"v_{c}"] != 0.0 for c in names)
    assert all(np.isnan(row[f"{k}_{c}"]) for k in "rsa" for c in names)


def test_roll_ups_of_undefined_attributions(spark):
    """Equal and NaN means: the second station is dominant, as in a comparison with ``>``."""
    rolled = [("f", "station", "a", float("nan")), ("f", "station", "b", float("nan")), ("g", "station", "b", 1.0), ("g", "station", "a", 1.0), ("h", "station", "a", 2.0), ("h", "station", "b", None)]
    wide = attribution.station_contrast(spark.createDataFrame(rolled, "feature string, scope string, member string, mean_abs double"), "a", "b")
    assert {r["feature"]: r["dominant"] for r in wide.collect()} == {"f": "b", "g": "b", "h": "a"}
    seasons = [("f", "season", s, float("nan")) for s in ("Winter", "Spring", "Summer")] + [("g", "season", "Winter", 1.0), ("g", "season", "Spring", 2.0), ("g", "season", "Summer", 2.0), ("g", "season", "Monsoon", None)]
    peaks = attribution.peak_season(spark.createDataFrame(seasons, "feature string, scope string, member string, mean_abs double"))
    assert {r["feature"]: r["peak_season"] for r in peaks.collect()} == {"f": "Spring", "g": "Spring"}


def test_readings_are_joined_once(spark, sf):
    """What the modelling, attribution and report queries read many times is stored, not joined again."""
    from checks import explaining, inputs, modelling, sources

    split = inputs.split(spark, sf)
    for df in (split, modelling.boxed_rows(spark, sf), explaining.phi(split), inputs.predictions(spark, sf).where("model = 'persistence_1'"), sources.report_lines(spark, sf)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan and "l_orderkey" not in plan
    lazy = {tuple(r) for r in inputs.daily(spark, sf).selectExpr("station", "date", "round(aqi, 6)", "temperature").collect()}
    assert {tuple(r) for r in split.selectExpr("station", "date", "round(aqi, 6)", "temperature").collect()} == lazy


def test_slow_models_join_the_readings_once(spark, sf, monkeypatch):
    """The queries of the forest and the boosted trees fit on the rows that they score, whose readings are joined once."""
    from checks import inputs, modelling, registry

    daily, joined = inputs.daily, []
    monkeypatch.setattr(inputs, "daily", lambda *args: joined.append(args) or daily(*args))
    for name, over in {"forest_model": {"numTrees": 2, "maxDepth": 2}, "boosting_model": {"maxIter": 2, "maxDepth": 2}, "stopped_boosting": {"maxIter": 2, "maxDepth": 2}}.items():
        monkeypatch.setattr(training, name, partial(getattr(training, name), **over))
    for name in ("m8_gradient_boosting", "m9_validation_curve", "m10_model_comparison", "m11_feature_importance"):
        monkeypatch.setattr(modelling, "_FITTED", {})
        joined.clear()
        assert registry.queries()[name](spark, sf).count() and len(joined) == 1, name
    plan = modelling.model_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "l_orderkey" not in plan
