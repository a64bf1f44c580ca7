"""Attribution roll-ups on a one-feature-at-a-time linear attribution, batch attribution and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.functions.calendar import season
from breezeframe.functions.air import HORIZONS
from breezeframe.functions.numeric import correlation, slope
from breezeframe.operators import attribution, history
from breezeframe.plans import explain, scenario, training

from . import inputs as I
from .joining import ANCHORS_SQL, anchors
from .modelling import FEATURES, model_rows
from .registry import check

_X = ["pm25", "pm10", "no2", "co", "o3", "temperature", "humidity", "wind_speed", "pressure"]
_SEASON = """CASE WHEN month(date) IN (11, 12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4) THEN 'Spring'
  WHEN month(date) IN (5, 6) THEN 'Summer' WHEN month(date) IN (7, 8, 9) THEN 'Monsoon' ELSE 'Post_Monsoon' END"""
_PHI = f"""
fits AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, round(regr_slope(aqi, {c}), 9) AS a, round(avg({c}), 9) AS m, abs(corr(aqi, {c})) AS importance FROM split WHERE split = 'train'" for c in _X)}),
wide AS ({' UNION ALL '.join(f"SELECT station, date, {_SEASON} AS season, '{c}' AS feature, {c} AS x FROM split" for c in _X)}),
phi AS (SELECT station, date, season, feature, a * (x - m) AS phi FROM wide JOIN fits USING (feature))"""
_BASE = I.with_(I.DAILY, I.SPLIT, _PHI)


def _fits(split):
    train = split.where("split = 'train'")
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            # Rounded in both engines before anything is ranked by them.
            F.round(slope("aqi", c), 9).alias("a"),
            F.round(F.avg(c), 9).alias("m"),
            F.abs(correlation("aqi", c)).alias("importance"),
        )
        for c in _X
    ]
    return train.agg(F.array(*entries).alias("f"))


def phi(split):
    fits = _fits(split).scalar()
    values = F.array(*[F.col(c) for c in _X])
    rows = split.select(
        "station",
        "date",
        season(F.month("date")).alias("season"),
        F.explode(F.arrays_zip(fits.alias("f"), values.alias("x"))).alias("e"),
    )
    e = F.col("e")
    f = e["f"]
    return rows.select(
        "station", "date", "season", f["feature"].alias("feature"), (f["a"] * (e["x"] - f["m"])).alias("phi")
    )


def _fit_rows(split):
    return _fits(split).select(F.explode("f").alias("f")).select("f.*")


_ROLLED = """, rolled AS (
  SELECT feature, CASE WHEN station IS NOT NULL THEN 'station' WHEN season IS NOT NULL THEN 'season' ELSE 'all' END AS scope,
    coalesce(station, season, 'all') AS member, avg(abs(phi)) AS mean_abs, avg(phi) AS mean_phi
  FROM phi GROUP BY GROUPING SETS ((feature), (feature, station), (feature, season)))
"""


@check(
    "a38_attribution_roll_up",
    _BASE + _ROLLED + "SELECT feature, scope, member, round(mean_abs, 6) AS mean_abs, round(mean_phi, 6) AS mean_phi FROM rolled",
)
def _(spark, sf):
    return I.rounded(attribution.roll_up(phi(I.split(spark, sf))), ["mean_abs", "mean_phi"])


@check(
    "a38_station_contrast",
    _BASE
    + _ROLLED
    + """, w AS (SELECT feature, max(mean_abs) FILTER (member = '1-URGENT') AS first, max(mean_abs) FILTER (member = '2-HIGH') AS second
      FROM rolled WHERE scope = 'station' GROUP BY 1)
    SELECT feature, round(first, 6) AS first, round(second, 6) AS second, round(first - second, 6) AS difference,
      CASE WHEN first > second THEN '1-URGENT' ELSE '2-HIGH' END AS dominant FROM w""",
)
def _(spark, sf):
    out = attribution.station_contrast(attribution.roll_up(phi(I.split(spark, sf))), "1-URGENT", "2-HIGH")
    return I.rounded(out, ["first", "second", "difference"])


@check(
    "a38_peak_season",
    _BASE
    + _ROLLED
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY mean_abs DESC) AS rn FROM rolled WHERE scope = 'season')
    SELECT feature, member AS peak_season, round(mean_abs, 6) AS peak_mean_abs FROM r WHERE rn = 1""",
)
def _(spark, sf):
    return I.rounded(attribution.peak_season(attribution.roll_up(phi(I.split(spark, sf)))), ["peak_mean_abs"])


_SCORED = _ROLLED + """, scored AS (SELECT r.feature, r.mean_abs, f.importance FROM rolled r JOIN fits f USING (feature) WHERE scope = 'all'),
span AS (SELECT min(mean_abs) AS l1, max(mean_abs) AS h1, min(importance) AS l2, max(importance) AS h2 FROM scored)
"""


def _scored(spark, sf):
    split = I.split(spark, sf)
    overall = attribution.roll_up(phi(split)).where("scope = 'all'").select("feature", "mean_abs")
    return overall.join(_fit_rows(split).select("feature", "importance"), "feature")


@check(
    "a39_fused_importance",
    _BASE
    + _SCORED
    + """, fused AS (SELECT feature, mean_abs, importance, ((mean_abs - l1) / (h1 - l1) + (importance - l2) / (h2 - l2)) / 2 AS fused FROM scored, span)
    SELECT feature, round(mean_abs, 6) AS mean_abs, round(importance, 6) AS importance, round(fused, 6) AS fused,
      row_number() OVER (ORDER BY round(fused.fused, 9) DESC, feature)::INTEGER AS rank FROM fused""",
)
def _(spark, sf):
    out = attribution.fuse(_scored(spark, sf), "mean_abs", "importance")
    return I.rounded(out, ["mean_abs", "importance", "fused"])


@check(
    "j8_ranking_agreement",
    _BASE
    + _SCORED
    + """, part AS (SELECT feature, mean_abs AS attribution, CASE WHEN feature IN ('co', 'pressure') THEN 0 ELSE importance END AS importance FROM scored),
    ranked AS (SELECT feature, attribution, importance, row_number() OVER (ORDER BY round(attribution, 9) DESC, feature) AS ar,
      row_number() OVER (ORDER BY round(importance, 9) DESC, feature) AS ir FROM part)
    SELECT feature, round(attribution, 6) AS attribution, round(importance, 6) AS importance, ar::INTEGER AS attribution_rank,
      ir::INTEGER AS importance_rank, abs(ar - ir)::INTEGER AS rank_difference,
      CASE WHEN abs(ar - ir) <= 2 THEN 'Strong' WHEN abs(ar - ir) <= 5 THEN 'Moderate' ELSE 'Weak' END AS agreement FROM ranked""",
)
def _(spark, sf):
    scored = _scored(spark, sf)
    # Two features have no model importance and count as zero.
    known = scored.where(~F.col("feature").isin("co", "pressure"))
    return I.rounded(attribution.compare_rankings(scored, known), ["attribution", "importance"])


@check(
    "k3_top_features",
    _BASE
    + """, top AS (SELECT feature, importance FROM fits ORDER BY round(importance, 9) DESC, feature LIMIT 5)
    SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY round(top.importance, 9) DESC, feature)::INTEGER AS rank FROM top""",
)
def _(spark, sf):
    out = attribution.top_features(_fit_rows(I.split(spark, sf)).select("feature", "importance"), "importance", 5)
    return I.rounded(out, ["importance"])


@check(
    "k4_top_coefficients",
    _BASE
    + """, top AS (SELECT feature, a FROM fits ORDER BY round(abs(a), 9) DESC, feature LIMIT 4)
    SELECT feature, round(a, 6) AS coefficient, row_number() OVER (ORDER BY round(abs(top.a), 9) DESC, feature)::INTEGER AS rank FROM top""",
)
def _(spark, sf):
    rows = _fit_rows(I.split(spark, sf)).select("feature", F.col("a").alias("coefficient"))
    return I.rounded(attribution.top_features(rows, "coefficient", 4, absolute=True), ["coefficient"])


@check(
    "k6_top_attributions_and_other",
    _BASE
    + """, r AS (SELECT station, date, feature, phi, row_number() OVER (PARTITION BY station, date ORDER BY round(abs(phi), 9) DESC, feature) AS rn FROM phi)
    SELECT station, date, CASE WHEN rn <= 4 THEN feature ELSE 'other' END AS feature, round(sum(phi), 6) AS phi FROM r
    GROUP BY station, date, CASE WHEN rn <= 4 THEN feature ELSE 'other' END""",
)
def _(spark, sf):
    return I.rounded(attribution.waterfall(phi(I.split(spark, sf)), ["station", "date"], 4), ["phi"])


@check(
    "k7_display_selection",
    _BASE
    + """, t AS (SELECT station, date, feature, phi, feature IN ('pm25', 'pm10', 'no2', 'wind_speed', 'humidity', 'temperature') AS fixed FROM phi),
    r AS (SELECT *, row_number() OVER (PARTITION BY station, date, fixed ORDER BY round(abs(phi), 9) DESC, feature) AS rn FROM t)
    SELECT station, date, feature, round(phi, 6) AS phi, row_number() OVER (PARTITION BY station, date ORDER BY round(r.phi, 9) DESC, feature)::INTEGER AS place
    FROM r WHERE fixed OR (rn <= 3 AND abs(phi) > 0.5)""",
)
def _(spark, sf):
    return I.rounded(attribution.display_selection(phi(I.split(spark, sf)), ["station", "date"]), ["phi"])


_TREE_FEATURES = ["lag_aqi_1", "roll_mean_aqi_7", "pm25", "pm10", "temperature", "humidity", "sin_month", "cos_month"]


@check("m13_coalition_attribution")
def _(spark, sf):
    rows = model_rows(spark, sf)
    train = rows.where("split = 'train'")
    model = training.tree_model(train, _TREE_FEATURES, 6)
    return explain.coalition_attribution(model, rows.where("split = 'test'"), train, _TREE_FEATURES)


@check("m14_occlusion_attribution")
def _(spark, sf):
    rows = model_rows(spark, sf)
    train = rows.where("split = 'train'")
    model = training.tree_model(train, _TREE_FEATURES, 6)
    explained = ["pm25", "pm10", "temperature", "humidity"]
    return explain.occlusion_attribution(model, rows.where("split = 'test'"), train, _TREE_FEATURES, explained)


@check("m15_recursive_forecast")
def _(spark, sf):
    d = I.stored_daily(spark, sf)
    rows = model_rows(spark, sf, d)
    model = training.linear_model(rows.where("split = 'train'"), FEATURES)
    # Every reading asks for its own moment, for one decades before and one decades after, and at a place without readings.
    where = F.explode(F.array(*(F.struct(F.lit(y).alias("years"), s.alias("station")) for y, s in ((0, F.col("station")), (-40, F.col("station")), (40, F.col("station")), (0, F.lit("no such place"))))))
    requests = d.withColumn("_w", where).withColumn("o_station", F.col("station")).withColumn("station", F.col("_w.station")).select(
        F.concat_ws(" ", "o_station", F.col("date").cast("string"), F.col("_w.years").cast("string"), "station").alias("request"),
        "station",
        (F.add_months("date", 12 * F.col("_w.years")).cast("timestamp_ntz") + F.make_dt_interval(hours=F.dayofmonth("date") % 24)).alias("at"),
        F.when(F.col("aqi") > 300, F.col("pm25") * 1.5).alias("o_pm25"),
        F.when(F.col("aqi") < 100, F.lit(90.0)).alias("o_humidity"),
    )
    return scenario.read_out(scenario.forecast_hours(requests, d, model, I.timeline()))


_PLACES = "places AS (SELECT * FROM (VALUES ('mid', 28.55::DOUBLE, 77.35::DOUBLE), ('edge', 28.7::DOUBLE, 77.2::DOUBLE)) t(place, lat, lon))"


@check(
    "m15_forecast_between_stations",
    I.with_(I.DAILY, I.SPLIT, ANCHORS_SQL, _PLACES)
    + """, l AS (SELECT *, lag(aqi) OVER (PARTITION BY station ORDER BY date) AS x FROM split),
    m AS (SELECT regr_slope(aqi, x) AS a, regr_intercept(aqi, x) AS b FROM l WHERE split = 'train'),
    w0 AS (SELECT place, station, 1 / ((p.lat - a.lat) ** 2 + (p.lon - a.lon) ** 2) AS w FROM places p, anchors a),
    w AS (SELECT place, station, w / sum(w) OVER (PARTITION BY place) AS w FROM w0),
    q AS (SELECT place, day, h, CAST(day AS TIMESTAMP) + to_hours(5 + h - 24) AS t
      FROM (SELECT DISTINCT date AS day FROM daily), places, (SELECT unnest([0, 1, 3, 6, 12]) AS h)),
    r AS (SELECT station, CAST(date AS TIMESTAMP) AS t, aqi FROM daily),
    k AS (SELECT q.*, w.station, w.w FROM q JOIN w USING (place)),
    f AS (SELECT k.*, r.t AS t0, r.aqi AS v0 FROM k ASOF LEFT JOIN r ON k.station = r.station AND k.t >= r.t),
    g AS (SELECT f.*, r.t AS t1, r.aqi AS v1 FROM f ASOF LEFT JOIN r ON f.station = r.station AND f.t < r.t),
    v AS (SELECT place, day, h, w * CASE WHEN t1 IS NULL OR (t0 IS NOT NULL AND epoch(t) - epoch(t0) <= epoch(t1) - epoch(t)) THEN v0 ELSE v1 END AS v FROM g),
    s AS (SELECT place, day, h, greatest(0, any_value(a) * sum(v) + any_value(b)) AS p FROM v, m GROUP BY 1, 2, 3),
    d AS (SELECT s.place, s.day, s.h, s.p FROM s UNION ALL
      SELECT s.place, s.day, 24, greatest(0, a * p + b) FROM s, m WHERE h = 0 UNION ALL
      SELECT s.place, s.day, 48, greatest(0, a * greatest(0, a * p + b) + b) FROM s, m WHERE h = 0 UNION ALL
      SELECT s.place, s.day, 72, greatest(0, a * greatest(0, a * greatest(0, a * p + b) + b) + b) FROM s, m WHERE h = 0)
    SELECT place || ' ' || CAST(day AS VARCHAR) AS request, h AS hours, round(p, 4) AS prediction FROM d WHERE h > 0""",
)
def _(spark, sf):
    d = I.stored_daily(spark, sf)
    s = I.split(spark, sf, d)
    train = history.add_lags(s, ["aqi"], [1], I.timeline()).where("split = 'train' AND lag_aqi_1 IS NOT NULL")
    model = training.linear_model(train, ["lag_aqi_1"])
    places = spark.createDataFrame([("mid", 28.55, 77.35), ("edge", 28.7, 77.2)], "place string, lat double, lon double")
    named = F.explode(F.array(F.lit("mid"), F.lit("edge"))).alias("place")
    asked = d.select("date").distinct().select("date", named).join(places, "place")
    requests = asked.select(
        F.concat_ws(" ", "place", F.col("date").cast("string")).alias("request"),
        F.lit(None).cast("string").alias("station"),
        (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(5))).alias("at"),
        "lat",
        "lon",
    )
    hourly = scenario.forecast_hours(requests, d, model, I.timeline(), anchors=anchors(spark, sf))
    return I.rounded(hourly.where(F.col("hours").isin(*HORIZONS)).select("request", "hours", "prediction"), ["prediction"], 4)


@check("m16_what_if_forecast")
def _(spark, sf):
    d = I.stored_daily(spark, sf)
    rows = model_rows(spark, sf, d)
    train = rows.where("split = 'train'")
    model = training.linear_model(train, FEATURES)
    scenarios = d.select(
        F.concat_ws(" ", "station", F.col("date").cast("string")).alias("scenario"),
        F.col("date").cast("timestamp_ntz").alias("at"),
        "pm25",
        "pm10",
        "temperature",
        "humidity",
        "wind_speed",
        "pressure",
        F.col("aqi").alias("lag_aqi_1"),
    )
    return scenario.what_if_steps(scenarios, model, FEATURES, train)


# Least squares of two features in closed form; the attribution of a linear model is slope times distance from the mean.
_TWO = I.with_(I.DAILY, I.SPLIT) + """, t AS (SELECT * FROM split WHERE split = 'train'),
  c AS (SELECT avg(pm10) AS mp, avg(co) AS mc, avg(aqi) AS my, var_pop(pm10) AS pp, var_pop(co) AS cc, covar_pop(pm10, co) AS pc,
    covar_pop(pm10, aqi) AS py, covar_pop(co, aqi) AS cy FROM t),
  m AS (SELECT *, (py * cc - cy * pc) / (pp * cc - pc * pc) AS a, (cy * pp - py * pc) / (pp * cc - pc * pc) AS b FROM c),
  x AS (SELECT station, date, a * (pm10 - mp) AS p, b * (co - mc) AS q, my FROM split, m WHERE split = 'test')
  SELECT station, date, 'pm10' AS feature, round(p, 3) AS phi, round(my + p + q, 3) AS prediction, round(my, 3) AS base FROM x
  UNION ALL SELECT station, date, 'co', round(q, 3), round(my + p + q, 3), round(my, 3) FROM x"""
_PAIR = ["pm10", "co"]


def _two(spark, sf):
    s = I.split(spark, sf)
    train = s.where("split = 'train'")
    return training.linear_model(train, _PAIR), train, s.where("split = 'test'")


@check("m13_linear_attribution", _TWO)
def _(spark, sf):
    model, train, test = _two(spark, sf)
    return I.rounded(explain.coalition_attribution(model, test, train, _PAIR), ["phi", "prediction", "base"], 3)


@check("m14_linear_occlusion", _TWO)
def _(spark, sf):
    model, train, test = _two(spark, sf)
    return I.rounded(explain.occlusion_attribution(model, test, train, _PAIR, _PAIR), ["phi", "prediction", "base"], 3)


@check(
    "m16_what_if_recursion",
    I.with_(I.DAILY, I.SPLIT).replace("WITH", "WITH RECURSIVE", 1)
    + """, l AS (SELECT *, lag(aqi) OVER (PARTITION BY station ORDER BY date) AS x FROM split),
    m AS (SELECT regr_slope(aqi, x) AS a, regr_intercept(aqi, x) AS b, avg(x) AS mean FROM l WHERE split = 'train' AND x IS NOT NULL),
    s AS (SELECT station || ' ' || CAST(date AS VARCHAR) AS scenario, 0 AS hours, coalesce(x, mean) AS v FROM l, m
      UNION ALL SELECT scenario, hours + 1, greatest(15.0, least(500.0, round(a * v + b, 1))) FROM s, m WHERE hours < 24)
    SELECT scenario, hours, CAST(floor(v) AS INTEGER) AS aqi FROM s WHERE hours > 0""",
)
def _(spark, sf):
    rows = history.add_lags(I.split(spark, sf), ["aqi"], [1], I.timeline())
    train = rows.where("split = 'train' AND lag_aqi_1 IS NOT NULL")
    model = training.linear_model(train, ["lag_aqi_1"])
    asked = rows.select(F.concat_ws(" ", "station", F.col("date").cast("string")).alias("scenario"), F.col("date").cast("timestamp_ntz").alias("at"), "lag_aqi_1")
    return scenario.what_if_steps(asked, model, ["lag_aqi_1"], train.withColumn("lag_aqi_7", F.col("lag_aqi_1"))).drop("at")
