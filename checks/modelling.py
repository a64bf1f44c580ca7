"""Spark ML models. Penalised models are checked in the one-feature case, which SQL can solve, and trees and boosted trees on
month and weekday, whose boxes SQL can grow level by level over the 84 cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.operators import attribution, history, scores
from breezeframe.plans import features as plan
from breezeframe.plans import training
from breezeframe.core.shared import cut_lineage
from breezeframe.operators.dedupe import concat_frames

from . import inputs as I
from .exploring import SCORE_SQL
from .features import feature_table
from .registry import check

FEATURES = [
    "lag_aqi_1", "lag_aqi_7", "roll_mean_aqi_7", "roll_std_aqi_7", "pm25", "pm10", "temperature", "humidity",
    "wind_speed", "sin_month", "cos_month", "interact_pm25_humidity",
]


def model_rows(spark, sf, daily=None):
    """Complete feature rows, stored once because fitting reads them many times."""
    kept = list(dict.fromkeys([*FEATURES, "aqi", "station", "date", "split"]))
    return cut_lineage(training.complete_rows(feature_table(spark, sf, daily).select(kept), FEATURES))


_ONE = I.with_(I.DAILY, I.SPLIT) + """, s AS (SELECT avg(pm10) AS mx, stddev_pop(pm10) AS sx, avg(aqi) AS my, count(*) AS n,
    covar_pop(pm10, aqi) / stddev_pop(pm10) AS c FROM split WHERE split = 'train')"""


def _one_feature(spark, sf, fit):
    s = I.split(spark, sf)
    model = fit(s.where("split = 'train'"))
    return I.rounded(model.transform(s).select("station", "date", "prediction"), ["prediction"], 4)


@check(
    "m3_linear_regression",
    _ONE + "SELECT station, date, round(my + c * (pm10 - mx) / sx, 4) AS prediction FROM split, s",
)
def _(spark, sf):
    return _one_feature(spark, sf, lambda t: training.linear_model(t, ["pm10"]))


@check(
    "m4_ridge_regression",
    _ONE + "SELECT station, date, round(my + (n * c / (n + 100.0::DOUBLE)) * (pm10 - mx) / sx, 4) AS prediction FROM split, s",
)
def _(spark, sf):
    return _one_feature(spark, sf, lambda t: training.ridge_model(t, ["pm10"], 100.0))


@check(
    "m5_lasso_regression",
    _ONE
    + "SELECT station, date, round(my + sign(c) * greatest(abs(c) - 0.25::DOUBLE, 0) * (pm10 - mx) / sx, 4) AS prediction FROM split, s",
)
def _(spark, sf):
    return _one_feature(spark, sf, lambda t: training.lasso_model(t, ["pm10"], 0.25))


@check(
    "m5_elastic_net",
    _ONE
    + """SELECT station, date, round(my + sign(c) * greatest(abs(c) - 0.2::DOUBLE * 0.5::DOUBLE, 0) / (1 + 0.2::DOUBLE * 0.5::DOUBLE)
      * (pm10 - mx) / sx, 4) AS prediction FROM split, s""",
)
def _(spark, sf):
    return _one_feature(spark, sf, lambda t: training.elastic_model(t, ["pm10"], 0.2, 0.5))


@check("m4_ridge_alpha_search")
def _(spark, sf):
    rows = model_rows(spark, sf)
    alpha, model, trace = training.tune_ridge(rows.where("split = 'train'"), rows.where("split = 'val'"), FEATURES)
    tried = spark.createDataFrame([(a, r, a == alpha) for a, r in trace], "alpha double, val_rmse double, chosen boolean")
    scored = training.score({f"ridge_{alpha}": model}, rows)
    test = scores.regression_scores(scored).where("split = 'test' AND station = 'Combined'")
    return tried.join(test.select(F.col("rmse").alias("test_rmse"), F.lit(alpha).alias("alpha")), "alpha", "left")


@check(
    "m4_ridge_alpha_search_one_feature",
    _ONE
    + f""", p AS (SELECT alpha, split, aqi, my + (n * c / (n + alpha)) * (pm10 - mx) / sx AS prediction
      FROM split, s, (SELECT unnest([{", ".join(f"{a}::DOUBLE" for a in training.ALPHAS)}]) AS alpha)),
    e AS (SELECT alpha, sqrt(avg((aqi - prediction) * (aqi - prediction)) FILTER (WHERE split = 'val')) AS val_rmse,
      sqrt(avg((aqi - prediction) * (aqi - prediction)) FILTER (WHERE split = 'test')) AS test_rmse FROM p GROUP BY alpha),
    b AS (SELECT *, alpha = arg_min(alpha, val_rmse) OVER () AS chosen FROM e)
    SELECT alpha, round(val_rmse, 5) AS val_rmse, chosen, CASE WHEN chosen THEN round(test_rmse, 5) END AS test_rmse FROM b""",
)
def _(spark, sf):
    """Every penalty of the grid with its validation error, and the test error of the chosen one."""
    rows = I.split(spark, sf)
    alpha, model, trace = training.tune_ridge(rows.where("split = 'train'"), rows.where("split = 'val'"), ["pm10"])
    tried = spark.createDataFrame([(a, r, a == alpha) for a, r in trace], "alpha double, val_rmse double, chosen boolean")
    test = scores.regression_scores(training.score({"ridge": model}, rows)).where("split = 'test' AND station = 'Combined'")
    found = tried.join(test.select(F.col("rmse").alias("test_rmse"), F.lit(alpha).alias("alpha")), "alpha", "left")
    return I.rounded(found, ["val_rmse", "test_rmse"], 5)


@check("m6_decision_tree_depth_search")
def _(spark, sf):
    rows = model_rows(spark, sf)
    depth, model, trace = training.tune_tree(rows.where("split = 'train'"), rows.where("split = 'val'"), FEATURES)
    tried = spark.createDataFrame([(d, r, d == depth) for d, r in trace], "depth int, val_rmse double, chosen boolean")
    scored = training.score({"tree": model}, rows)
    test = scores.regression_scores(scored).where("split = 'test' AND station = 'Combined'")
    return tried.join(test.select(F.col("rmse").alias("test_rmse"), F.lit(depth).alias("depth")), "depth", "left")


BOXED = ["month", "weekday"]


def boxed_rows(spark, sf):
    return I.split(spark, sf).withColumns({"month": F.month("date"), "weekday": F.dayofweek("date")})


_BOXED = I.with_(I.DAILY, I.SPLIT) + """, base AS MATERIALIZED (SELECT *, month(date) AS m, dayofweek(date) + 1 AS w FROM split),
    grid AS (SELECT m, w FROM range(1, 13) AS a(m), range(1, 8) AS b(w)),
    cuts AS (SELECT 'm' AS f, c FROM range(1, 12) AS a(c) UNION ALL SELECT 'w', c FROM range(1, 7) AS b(c)),
    """


def _cells(where: str) -> str:
    """Rows and label sums of the training rows in each cell."""
    return f"""(SELECT m, w, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM grid LEFT JOIN
      (SELECT m, w, count(*) AS n, sum(aqi) AS s FROM base WHERE split = 'train' AND {where} GROUP BY m, w) USING (m, w))"""


def _grown(name: str, cells: str, depth: int, least: int) -> list[str]:
    """CTEs of a least-squares tree on ``cells(m, w, n, s)``: splits ``_b0 ..`` and the mean of every box of every level, ``_v``."""
    box = "m > m0 AND m <= m1 AND w > w0 AND w <= w1"
    left = "FILTER (WHERE CASE f WHEN 'm' THEN m <= c ELSE w <= c END)"
    ctes = [f"{name}_n0 AS (SELECT 0 AS m0, 12 AS m1, 0 AS w0, 7 AS w1)"]
    for k in range(depth):
        ctes += [
            f"""{name}_c{k} AS (SELECT m0, m1, w0, w1, f, c, sum(n) AS n, sum(s) AS s, sum(n) {left} AS nl, sum(s) {left} AS sl FROM {name}_n{k}
              JOIN cuts ON (f = 'm' AND c > m0 AND c < m1) OR (f = 'w' AND c > w0 AND c < w1) JOIN {cells} ON {box} GROUP BY m0, m1, w0, w1, f, c)""",
            f"""{name}_b{k} AS MATERIALIZED (SELECT m0, m1, w0, w1, arg_max({{'f': f, 'c': c}}, gain) AS cut, max(gain) AS gain FROM
              (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM {name}_c{k} WHERE nl >= {least} AND n - nl >= {least})
              WHERE gain > 1e-9 GROUP BY m0, m1, w0, w1)""",
            f"""{name}_n{k + 1} AS MATERIALIZED (SELECT m0, CASE cut.f WHEN 'm' THEN cut.c ELSE m1 END AS m1, w0, CASE cut.f WHEN 'w' THEN cut.c ELSE w1 END AS w1
              FROM {name}_b{k} UNION ALL SELECT CASE cut.f WHEN 'm' THEN cut.c ELSE m0 END, m1, CASE cut.f WHEN 'w' THEN cut.c ELSE w0 END, w1 FROM {name}_b{k})""",
        ]
    boxes = " UNION ALL ".join(f"SELECT {k} AS level, * FROM {name}_n{k}" for k in range(depth + 1))
    return [*ctes, f"{name}_v AS MATERIALIZED (SELECT level, m0, m1, w0, w1, sum(s) / sum(n) AS value FROM ({boxes}) JOIN {cells} ON {box} GROUP BY level, m0, m1, w0, w1)"]


def _boosted(where: str, rounds: int, depth: int, least: int, step: float) -> str:
    """CTEs ``r1 .. rk``: cells with their rows, label sums and the forecast ``v`` of the first k trees."""
    ctes = [f"t1 AS MATERIALIZED {_cells(where)}"]
    for k in range(1, rounds + 1):
        ctes += _grown(f"g{k}", f"t{k}", depth, least)
        before, weight = (f"r{k - 1}", step) if k > 1 else ("(SELECT m, w, n, s, 0.0::DOUBLE AS v FROM t1)", 1.0)
        ctes.append(
            f"""r{k} AS MATERIALIZED (SELECT p.m, p.w, p.n, p.s, any_value(p.v) + {weight}::DOUBLE * arg_max(value, level) AS v FROM {before} p
              JOIN g{k}_v ON p.m > m0 AND p.m <= m1 AND p.w > w0 AND p.w <= w1 GROUP BY p.m, p.w, p.n, p.s)"""
        )
        ctes.append(f"t{k + 1} AS MATERIALIZED (SELECT m, w, n, 2 * (s - n * v) AS s FROM r{k})")  # the negative gradient of the squared error
    return ", ".join(ctes)


@check(
    "m6_tree_depths_on_calendar",
    _BOXED
    + f"t AS MATERIALIZED {_cells('true')}, "
    + ", ".join(_grown("g", "t", 3, 5))
    + """, p AS (SELECT depth, station, date, aqi, arg_max(value, level) AS value FROM base, range(1, 4) AS d(depth), g_v
      WHERE split = 'val' AND m > m0 AND m <= m1 AND w > w0 AND w <= w1 AND level <= depth GROUP BY depth, station, date, aqi),
    e AS (SELECT depth, sqrt(avg((aqi - value) * (aqi - value))) AS val_rmse FROM p GROUP BY depth)
    SELECT CAST(depth AS INTEGER) AS depth, round(val_rmse, 6) AS val_rmse, val_rmse = min(val_rmse) OVER () AS chosen FROM e""",
)
def _(spark, sf):
    rows = boxed_rows(spark, sf)
    depth, _, trace = training.tune_tree(rows.where("split = 'train'"), rows.where("split = 'val'"), BOXED, (1, 2, 3))
    tried = spark.createDataFrame([(d, r, d == depth) for d, r in trace], "depth int, val_rmse double, chosen boolean")
    return I.rounded(tried, ["val_rmse"])


@check(
    "m8_boosting_on_calendar",
    _BOXED + _boosted("true", 4, 2, 10, 0.05) + " SELECT station, date, round(v, 6) AS prediction FROM base JOIN r4 USING (m, w)",
)
def _(spark, sf):
    rows = boxed_rows(spark, sf)
    whole = {"subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    model = training.boosting_model(rows.where("split = 'train'"), BOXED, maxIter=4, maxDepth=2, **whole)
    return I.rounded(model.transform(rows).select("station", "date", "prediction"), ["prediction"])


@check(
    "m9_stopping_on_calendar",
    _BOXED
    + _boosted("day(date) % 10 <> 3", 6, 2, 20, 0.5)
    + ", e AS ("
    + " UNION ALL ".join(
        f"SELECT {k} AS trees, avg((aqi - v) * (aqi - v)) AS mse FROM base JOIN r{k} USING (m, w) WHERE split = 'train' AND day(date) % 10 = 3" for k in range(1, 7)
    )
    + ") SELECT CAST(trees AS INTEGER) AS trees, round(mse, 6) AS held_mse, trees = arg_min(trees, mse) OVER () AS kept FROM e",
)
def _(spark, sf):
    """Held-out error of each prefix of the ensemble, and the round that is kept."""
    train = boxed_rows(spark, sf).where("split = 'train'")
    held = F.dayofmonth("date") % 10 == 3
    stopped = training.stopped_boosting(train, BOXED, held=held, first=6, maxIter=6, maxDepth=2, stepSize=0.5)
    rows = [(k + 1, e, k + 1 == stopped.rounds) for k, e in enumerate(stopped.curve)]
    return I.rounded(spark.createDataFrame(rows, "trees int, held_mse double, kept boolean"), ["held_mse"])


@check(
    "m11_importance_on_calendar",
    _BOXED
    + f"t AS MATERIALIZED {_cells('true')}, "
    + ", ".join(_grown("g", "t", 3, 5))
    + ", b AS ("
    + " UNION ALL ".join(f"SELECT cut.f AS f, gain FROM g_b{k}" for k in range(3))
    + """) SELECT feature, round(coalesce(100 * sum(gain) / sum(sum(gain)) OVER (), 0), 6) AS importance
    FROM (VALUES ('month', 'm'), ('weekday', 'w')) AS x(feature, f) LEFT JOIN b USING (f) GROUP BY feature""",
)
def _(spark, sf):
    train = boxed_rows(spark, sf).where("split = 'train'")
    model = training.tree_model(train, BOXED, 3)
    return I.rounded(training.importance(model, BOXED, train).select("feature", "importance"), ["importance"])


_FITTED: dict[tuple[str, str, str], object] = {}


def fitted(spark, sf, name, rows=None):
    """One of the slow models at its full settings, fitted on ``model_rows`` once in a session for all queries that score it."""
    fits = {"forest": training.forest_model, "boosting": training.boosting_model, "stopped": training.stopped_boosting}
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITTED:
        _FITTED[key] = fits[name]((model_rows(spark, sf) if rows is None else rows).where("split = 'train'"), FEATURES)
    return _FITTED[key]


def _ranked(spark, sf, pick):
    """Scores of the model that ``pick`` takes from the training on the same rows."""
    rows = model_rows(spark, sf)
    ranked, _gap = training.evaluate(training.score({"model": pick(rows)}, rows))
    return ranked


@check("m7_random_forest")
def _(spark, sf):
    return _ranked(spark, sf, lambda rows: fitted(spark, sf, "forest", rows))


@check("m8_gradient_boosting")
def _(spark, sf):
    return _ranked(spark, sf, lambda rows: fitted(spark, sf, "boosting", rows))


@check("m9_early_stopping_boosting")
def _(spark, sf):
    return _ranked(spark, sf, lambda rows: fitted(spark, sf, "stopped", rows).model)


@check("m9_validation_curve")
def _(spark, sf):
    """Held-out error of every number of trees and the round that is kept."""
    stopped = fitted(spark, sf, "stopped")
    rows = [(k + 1, e, k + 1 == stopped.rounds) for k, e in enumerate(stopped.curve)]
    return spark.createDataFrame(rows, "trees int, held_mse double, kept boolean")


@check(
    "m10_model_scores",
    I.with_(I.DAILY, I.SPLIT)
    + f""", m AS (SELECT regr_slope(aqi, pm10) AS a, regr_intercept(aqi, pm10) AS b FROM split WHERE split = 'train'),
    p AS (SELECT split.*, a * pm10 + b AS prediction FROM split, m)
    SELECT 'linear' AS model, split, coalesce(station, 'Combined') AS station, {SCORE_SQL}
    FROM p GROUP BY GROUPING SETS ((split, station), (split))""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    model = training.linear_model(s.where("split = 'train'"), ["pm10"])
    return I.rounded(scores.regression_scores(training.score({"linear": model}, s)), list(scores.SCORES), 5)


@check("m10_model_comparison")
def _(spark, sf):
    """Two persistence forecasts, two linear models, a tree, a forest and two boosted ensembles, by split and station."""
    rows = model_rows(spark, sf)
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    alpha, ridge, _ = training.tune_ridge(train, val, FEATURES)
    depth, tree, _ = training.tune_tree(train, val, FEATURES)
    models = {
        "linear": training.linear_model(train, FEATURES),
        f"ridge_{alpha}": ridge,
        f"tree_{depth}": tree,
        "forest": fitted(spark, sf, "forest", rows),
        "boosting": fitted(spark, sf, "boosting", rows),
        "stopped_boosting": fitted(spark, sf, "stopped", rows).model,
    }
    scored = training.score(models, rows).unionByName(training.persistence(rows))
    ranked, gap = training.evaluate(scored)
    return ranked.join(gap.select("model", "overfit_gap"), "model")


_SIX = {
    "linear": "SELECT *, my + c * (pm10 - mx) / sx AS prediction FROM q, line",
    "ridge_100": "SELECT *, my + (n * c / (n + 100.0::DOUBLE)) * (pm10 - mx) / sx AS prediction FROM q, line",
    "tree_3": "SELECT *, v AS prediction FROM q JOIN leaf USING (m, w)",
    "boosting": "SELECT *, v AS prediction FROM q JOIN r4 USING (m, w)",
    "persistence_1": "SELECT *, one AS prediction FROM q",
    "persistence_7": "SELECT *, seven AS prediction FROM q",
}


@check(
    "m10_six_models_compared",
    _BOXED
    + f"t AS MATERIALIZED {_cells('true')}, "
    + ", ".join(_grown("g", "t", 3, 5))
    + ", "
    + _boosted("true", 4, 2, 10, 0.05)
    + """, line AS (SELECT avg(pm10) AS mx, stddev_pop(pm10) AS sx, avg(aqi) AS my, count(*) AS n, covar_pop(pm10, aqi) / stddev_pop(pm10) AS c
      FROM base WHERE split = 'train'),
    leaf AS (SELECT grid.m, grid.w, arg_max(value, level) AS v FROM grid JOIN g_v ON grid.m > m0 AND grid.m <= m1 AND grid.w > w0 AND grid.w <= w1
      GROUP BY grid.m, grid.w),
    q AS (SELECT * FROM (SELECT *, lag(aqi, 1) OVER x AS one, lag(aqi, 7) OVER x AS seven FROM base WINDOW x AS (PARTITION BY station ORDER BY date))
      WHERE seven IS NOT NULL),
    p AS ("""
    + " UNION ALL ".join(f"SELECT '{name}' AS model, split, station, aqi, prediction FROM ({sql})" for name, sql in _SIX.items())
    + f"""), e AS (SELECT model, split, coalesce(station, 'Combined') AS station, {SCORE_SQL} FROM p GROUP BY GROUPING SETS ((model, split, station), (model, split))),
    o AS (SELECT model, max(rmse) FILTER (split = 'train') - max(rmse) FILTER (split = 'val') AS gap FROM e WHERE station = 'Combined' GROUP BY model)
    SELECT model, split, station, n, rmse, mae, r2, row_number() OVER (PARTITION BY split, station ORDER BY rmse, model)::INTEGER AS rank,
      round(gap, 4) AS overfit_gap FROM e JOIN o USING (model)""",
)
def _(spark, sf):
    """Scores by split and station, rank and overfit gap of two linear models, a tree, boosted trees and two persistence forecasts."""
    rows = boxed_rows(spark, sf)
    train = rows.where("split = 'train'")
    models = {
        "linear": training.linear_model(train, ["pm10"]),
        "ridge_100": training.ridge_model(train, ["pm10"], 100.0),
        "tree_3": training.tree_model(train, BOXED, 3),
        "boosting": training.boosting_model(train, BOXED, maxIter=4, maxDepth=2, subsamplingRate=1.0, featureSubsetStrategy="all"),
    }
    lagged = cut_lineage(history.add_lags(rows, ["aqi"], training.PERSISTENCE_LAGS, I.timeline()).where("lag_aqi_7 IS NOT NULL"))
    scored = training.score(models, lagged).unionByName(training.persistence(lagged))
    found = I.rounded(scores.regression_scores(scored), list(scores.SCORES), 5)
    gap = I.rounded(scores.overfit_gap(found), ["overfit_gap"], 4).select("model", "overfit_gap")
    return scores.rank_models(found).join(gap, "model").select("model", "split", "station", "n", "rmse", "mae", "r2", "rank", "overfit_gap")


@check(
    "m10_persistence_scores",
    I.with_(I.DAILY, I.SPLIT)
    + f""", l AS (SELECT *, lag(aqi, 1) OVER w AS one, lag(aqi, 7) OVER w AS seven FROM split WINDOW w AS (PARTITION BY station ORDER BY date)),
    p AS (SELECT 'persistence_1' AS model, split, station, date, aqi, one AS prediction FROM l WHERE seven IS NOT NULL
      UNION ALL SELECT 'persistence_7', split, station, date, aqi, seven FROM l WHERE seven IS NOT NULL)
    SELECT model, split, coalesce(station, 'Combined') AS station, {SCORE_SQL}
    FROM p GROUP BY GROUPING SETS ((model, split, station), (model, split))""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    lagged = history.add_lags(s, ["aqi"], training.PERSISTENCE_LAGS, I.timeline()).where("lag_aqi_7 IS NOT NULL")
    return I.rounded(scores.regression_scores(training.persistence(lagged)), list(scores.SCORES), 5)


@check("m11_feature_importance")
def _(spark, sf):
    rows = model_rows(spark, sf)
    train = rows.where("split = 'train'")
    models = [fitted(spark, sf, name, rows) for name in ("forest", "boosting")]
    both = concat_frames([training.importance(m, FEATURES, train) for m in models])
    return attribution.top_features(attribution.mean_importance(both), "importance", 10)


@check("m12_permutation_importance")
def _(spark, sf):
    rows = model_rows(spark, sf)
    model = training.linear_model(rows.where("split = 'train'"), FEATURES)
    return training.permutation_importance(model, rows.where("split = 'test'"), FEATURES)


@check("curated_feature_coverage")
def _(spark, sf):
    table = feature_table(spark, sf)
    wanted = [c for c in plan.MODEL_FEATURES if c in table.columns]
    return plan.inventory(table.select("station", "date", "aqi", *wanted))
