"""Look-back, calendar, interaction and station features."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.functions import calendar as cal
from breezeframe.functions.interactions import interactions
from breezeframe.operators import history, scores, splits, stations
from breezeframe.plans import features as plan

from . import inputs as I
from .registry import check

_W = "WINDOW w AS (PARTITION BY station ORDER BY date)"
_LAG_COLS = ["aqi", "pm25", "pm10", "no2", "co", "o3", "temperature", "wind_speed", "humidity"]
_LAGS = [1, 2, 3, 7, 14, 30]
_ROLL_COLS = ["aqi", "pm25", "pm10", "temperature", "wind_speed"]
_WINDOWS = [3, 7, 14, 30]


def flagship(spark, sf):
    """Persistence forecast with a weekly mean and an episode flag, scored per station and together."""
    d = I.daily(spark, sf)
    looked = I.timeline().select(
        d,
        lambda f: {
            **history.lag_columns(f, ["aqi"], [1, 7]),
            **history.rolling_columns(f, ["aqi"], [7], ["mean"]),
        },
        before=7,
    )
    flagged = looked.withColumn(
        "episode", F.coalesce(F.col("roll_mean_aqi_7") > history.EPISODE_AQI, F.lit(False)).cast("int")
    )
    predicted = scores.persistence(flagged, 1).withColumn("model", F.lit("persistence_1"))
    out = scores.regression_scores(predicted, by=["model", "episode"])
    return I.rounded(out, list(scores.SCORES), 5)


_SCORE_SQL = """count(*) AS n, round(sqrt(avg((aqi - prediction) * (aqi - prediction))), 5) AS rmse,
  round(avg(abs(aqi - prediction)), 5) AS mae,
  round(avg(abs(aqi - prediction) / greatest(abs(aqi), 1e-8)) * 100, 5) AS mape,
  round(avg(abs(aqi - prediction) / ((abs(aqi) + abs(prediction)) / 2 + 1e-8)) * 100, 5) AS smape,
  round(1 - sum((aqi - prediction) * (aqi - prediction)) / (count(*) * var_pop(aqi)), 5) AS r2"""

check(
    "flagship_persistence_scores",
    I.with_(I.DAILY)
    + f""", looked AS (SELECT *, lag(aqi, 1) OVER w AS prediction,
      avg(aqi) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7 FROM daily {_W}),
    p AS (SELECT 'persistence_1' AS model, CAST(coalesce(m7 > 300, false) AS INTEGER) AS episode, * FROM looked WHERE prediction IS NOT NULL)
    SELECT model, episode, coalesce(station, 'Combined') AS station, {_SCORE_SQL}
    FROM p GROUP BY GROUPING SETS ((model, episode, station), (model, episode))""",
)(flagship)


@check(
    "w1_lags",
    I.with_(I.DAILY)
    + "SELECT station, date, "
    + ", ".join(f"round(lag({c}, {k}) OVER w, 6) AS lag_{c}_{k}" for c in _LAG_COLS for k in _LAGS)
    + f" FROM daily {_W}",
)
def _(spark, sf):
    out = history.add_lags(I.daily(spark, sf), timeline=I.timeline())
    names = history.lag_names(_LAG_COLS)
    return I.rounded(out.select("station", "date", *names), names)


def _rolling_sql(stat: str, fn: str) -> str:
    cols = [
        f"round({fn.format(c)} OVER (PARTITION BY station ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS roll_{stat}_{c}_{n}"
        for c in _ROLL_COLS
        for n in _WINDOWS
    ]
    return I.with_(I.DAILY) + "SELECT station, date, " + ", ".join(cols) + " FROM daily"


def _rolling(spark, sf, stats):
    out = history.add_rolling(I.daily(spark, sf), _ROLL_COLS, _WINDOWS, stats, I.timeline())
    names = [f"roll_{s}_{c}_{n}" for c in _ROLL_COLS for n in _WINDOWS for s in stats]
    return I.rounded(out.select("station", "date", *names), names)


@check("w2_rolling_mean", _rolling_sql("mean", "avg({})"))
def _(spark, sf):
    return _rolling(spark, sf, ["mean"])


@check("w2_rolling_min", _rolling_sql("min", "min({})"))
def _(spark, sf):
    return _rolling(spark, sf, ["min"])


@check("w2_rolling_max", _rolling_sql("max", "max({})"))
def _(spark, sf):
    return _rolling(spark, sf, ["max"])


@check("w3_rolling_std", _rolling_sql("std", "stddev_samp({})"))
def _(spark, sf):
    return _rolling(spark, sf, ["std"])


@check("w4_rolling_median", _rolling_sql("median", "median({})"))
def _(spark, sf):
    return _rolling(spark, sf, ["median"])


_TREND = ", ".join(
    f"""round(CASE WHEN count(aqi) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n}
    THEN regr_slope(aqi, rn) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END, 6)
    AS roll_trend_aqi_{n}"""
    for n in (7, 30)
)


@check(
    "w5_rolling_trend",
    I.with_(I.DAILY)
    + f", numbered AS (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS rn FROM daily {_W}) SELECT station, date, {_TREND} FROM numbered",
)
def _(spark, sf):
    out = history.add_trend(I.daily(spark, sf), timeline=I.timeline())
    names = ["roll_trend_aqi_7", "roll_trend_aqi_30"]
    return I.rounded(out.select("station", "date", *names), names)


@check(
    "w6_momentum_n7_episode",
    I.with_(I.DAILY)
    + """, m AS (SELECT station, date,
      avg(aqi) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3,
      avg(aqi) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7 FROM daily)
    SELECT station, date, round(m3 - m7, 4) AS roll_aqi_momentum, CAST(coalesce(m7 > 300, false) AS INTEGER) AS roll_episode_flag FROM m""",
)
def _(spark, sf):
    out = history.add_rolling(I.daily(spark, sf), ["aqi"], [3, 7], ["mean"], I.timeline())
    return out.withColumns(history.derived_columns()).select(
        "station", "date", "roll_aqi_momentum", "roll_episode_flag"
    )


@check(
    "n1_calendar_parts",
    I.with_(I.DAILY)
    + """SELECT station, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
      CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
      CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(quarter(date) AS INTEGER) AS quarter,
      CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend FROM daily""",
)
def _(spark, sf):
    return I.daily(spark, sf).select(
        "station", "date", *[c.alias(n) for n, c in cal.calendar_parts(F.col("date")).items()]
    )


_PARTS = {"month": ("month(date)", 12), "day_of_year": ("dayofyear(date)", 365.25), "day_of_week": ("(isodow(date) - 1)", 7), "week_of_year": ("weekofyear(date)", 52)}


@check(
    "n2_cyclical_parts",
    I.with_(I.DAILY)
    + "SELECT station, date, "
    + ", ".join(
        f"round(sin(2 * pi() * {e} / {p}), 6) + 0.0 AS sin_{n}, round(cos(2 * pi() * {e} / {p}), 6) + 0.0 AS cos_{n}"
        for n, (e, p) in _PARTS.items()
    )
    + " FROM daily",
)
def _(spark, sf):
    # Adding zero turns a rounded -0.0 into 0.0 on both sides.
    return I.daily(spark, sf).select(
        "station",
        "date",
        *[(c + F.lit(0.0)).alias(n) for n, c in cal.cyclical_parts(F.col("date")).items()],
    )


@check(
    "n2_hour_cycle",
    """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos
    FROM events""",
)
def _(spark, sf):
    return I.table(spark, sf, "events").select(
        "event_id", *[(c + F.lit(0.0)).alias(n) for n, c in cal.hour_cycle(F.col("ts")).items()]
    )


_SEASON = """CASE WHEN month(date) IN (11, 12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4) THEN 'Spring'
  WHEN month(date) IN (5, 6) THEN 'Summer' WHEN month(date) IN (7, 8, 9) THEN 'Monsoon' ELSE 'Post_Monsoon' END"""
_SEASON_API = """CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4) THEN 'Spring'
  WHEN month(date) IN (5, 6) THEN 'Summer' WHEN month(date) IN (7, 8, 9) THEN 'Monsoon' ELSE 'Post_Monsoon' END"""


@check(
    "n3_season_schemes",
    I.with_(I.DAILY) + f"SELECT station, date, {_SEASON} AS training, {_SEASON_API} AS api FROM daily",
)
def _(spark, sf):
    m = F.month("date")
    return I.daily(spark, sf).select(
        "station", "date", cal.season(m).alias("training"), cal.season(m, "api").alias("api")
    )


@check(
    "n4_season_flags",
    I.with_(I.DAILY)
    + f", s AS (SELECT station, date, {_SEASON} AS season FROM daily) SELECT station, date, "
    + ", ".join(f"CAST(season = '{s}' AS INTEGER) AS season_{s}" for s in cal.SEASONS)
    + " FROM s",
)
def _(spark, sf):
    flags = cal.season_flags(cal.season(F.month("date")))
    return I.daily(spark, sf).select("station", "date", *[c.alias(n) for n, c in flags.items()])


@check(
    "n5_event_flags",
    I.with_(I.DAILY)
    + """, moved AS (SELECT station, CAST(date + INTERVAL 21 YEAR AS DATE) AS date, aqi FROM daily)
    SELECT station, date, CAST(date BETWEEN DATE '2020-03-24' AND DATE '2021-06-30' AS INTEGER) AS is_covid_lockdown,
      CAST((month(date) = 10 AND day(date) >= 20) OR (month(date) = 11 AND day(date) <= 5) AS INTEGER) AS is_diwali,
      CAST(month(date) IN (10, 11) AS INTEGER) AS is_stubble_burning, CAST(aqi = 500 AS INTEGER) AS aqi_saturated
    FROM moved""",
)
def _(spark, sf):
    d = I.daily(spark, sf).withColumn("date", F.add_months("date", 21 * 12))
    flags = cal.event_flags(F.col("date"), F.col("aqi"))
    return d.select("station", "date", *[c.alias(n) for n, c in flags.items()])


@check(
    "n6_interactions",
    I.with_(I.DAILY)
    + f""", l AS (SELECT *, lag(aqi) OVER w AS lag1 FROM daily {_W})
    SELECT station, date, round(pm25 * humidity / 100, 4) AS interact_pm25_humidity,
      round(pm10 / (wind_speed + 1), 4) AS interact_pm10_wind_accum, round(temperature * o3 / 100, 4) AS interact_temp_o3,
      round(co * pm25, 4) AS interact_co_pm25, round(temperature * humidity / 100, 4) AS interact_temp_humidity,
      round(wind_speed * humidity / 100, 4) AS interact_wind_humidity,
      round(least(pm25 / greatest(pm10, 1.0), 2.0), 4) AS interact_pm25_pm10_ratio, round(no2 * co, 4) AS interact_no2_co,
      round(pressure / 1013.0::DOUBLE * (1.0::DOUBLE / greatest(temperature + 30, 1.0)) * 100, 4) AS interact_pressure_temp_stability,
      round(lag1 * CASE WHEN month(date) IN (11, 12, 1, 2) THEN 1 ELSE 0 END, 4) AS interact_lag_aqi1_winter,
      round(pm25 * CASE WHEN month(date) IN (10, 11) THEN 1 ELSE 0 END, 4) AS interact_pm25_stubble,
      round(wind_speed * wind_speed, 4) AS interact_wind_speed_sq FROM l""",
)
def _(spark, sf):
    d = history.add_lags(plan.add_temporal(I.daily(spark, sf)), ["aqi"], [1], I.timeline())
    made = interactions(d.columns)
    return d.select("station", "date", *[c.alias(n) for n, c in made.items()])


@check(
    "n12_station_codes",
    I.with_(I.DAILY)
    + """SELECT station, date, CASE station WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
      WHEN '4-NOT SPECIFIED' THEN 3 ELSE -1 END AS station_encoded FROM daily""",
)
def _(spark, sf):
    return stations.encode_stations(I.daily(spark, sf), I.CODES).select("station", "date", "station_encoded")


@check(
    "n12_station_code_table",
    """SELECT c.c_custkey, coalesce(CAST(n.n_nationkey AS INTEGER), -1) AS station_encoded FROM customer c
    LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3""",
)
def _(spark, sf):
    c = I.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("station"))
    codes = I.table(spark, sf, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").alias("station"), F.col("n_nationkey").alias("code")
    )
    return stations.encode_from_table(c, codes).select("c_custkey", "station_encoded")


_STATS_SQL = f"""
seasoned AS (SELECT *, {_SEASON} AS season FROM split),
train AS (SELECT * FROM seasoned WHERE split = 'train'),
grand AS (SELECT avg(aqi) AS g FROM train),
stats AS (SELECT station, round(avg(aqi), 4) AS station_mean_aqi, round(stddev_samp(aqi), 4) AS station_std_aqi,
    round(avg(pm25), 4) AS station_mean_pm25, round(avg(pm10), 4) AS station_mean_pm10, round(avg(temperature), 4) AS station_mean_temp,
    round(round(avg(aqi), 4) - any_value(g), 4) AS station_aqi_offset
  FROM train, grand GROUP BY station),
seasonal AS (SELECT station, {', '.join(f"round(coalesce(round(avg(aqi) FILTER (season = '{s}'), 4), any_value(g)), 6) AS station_season_mean_{s.lower()}" for s in cal.SEASONS)}
  FROM train, grand GROUP BY station)"""
_SEASON_COLS = [f"station_season_mean_{s.lower()}" for s in cal.SEASONS]
_STAT_COLS = [
    "station_mean_aqi", "station_std_aqi", "station_mean_pm25", "station_mean_pm10", "station_mean_temp", "station_aqi_offset",
]


def _train(spark, sf):
    s = I.split(spark, sf).withColumn("season", cal.season(F.month("date")))
    return s.where(F.col("split") == "train")


@check("a8_station_statistics", I.with_(I.DAILY, I.SPLIT, _STATS_SQL) + "SELECT * FROM stats")
def _(spark, sf):
    return stations.learn_stations(_train(spark, sf)).select("station", *_STAT_COLS)


@check(
    "a9_station_season_pivot",
    I.with_(I.DAILY, I.SPLIT, _STATS_SQL)
    + "SELECT station, "
    + ", ".join(f"station_season_mean_{s.lower()} AS {s}" for s in cal.SEASONS)
    + " FROM seasonal",
)
def _(spark, sf):
    return I.rounded(stations.season_means(_train(spark, sf)), list(cal.SEASONS))


@check(
    "j1_station_lookup",
    I.with_(I.DAILY, I.SPLIT, _STATS_SQL)
    + f"SELECT s.station, s.date, {', '.join(_STAT_COLS)} FROM split s LEFT JOIN stats USING (station)",
)
def _(spark, sf):
    learned = stations.learn_stations(_train(spark, sf)).select("station", *_STAT_COLS)
    joined = stations.add_station_statistics(I.split(spark, sf), learned)
    return joined.select("station", "date", *_STAT_COLS)


@check(
    "j2_station_season_lookup",
    I.with_(I.DAILY, I.SPLIT, _STATS_SQL)
    + f""", part AS (SELECT * FROM seasonal WHERE station <> '5-LOW')
    SELECT s.station, s.date, {', '.join(f'coalesce(p.{c}, round(g, 6)) AS {c}' for c in _SEASON_COLS)}
    FROM split s CROSS JOIN grand LEFT JOIN part p USING (station)""",
)
def _(spark, sf):
    train = _train(spark, sf)
    # One station is left out of the pivot and must fall back to the grand mean.
    pivot = stations.season_means(train).where(F.col("station") != "5-LOW")
    joined = stations.add_season_means(I.split(spark, sf), pivot, train)
    return I.rounded(joined.select("station", "date", *_SEASON_COLS), _SEASON_COLS)


_HOLIDAY_SQL = """holidays AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
  WHERE (month(o_orderdate) = 1 AND day(o_orderdate) = 1) OR (month(o_orderdate) = 12 AND day(o_orderdate) = 25))"""


def _holidays(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    m, d = F.month("date"), F.dayofmonth("date")
    return o.where(((m == 1) & (d == 1)) | ((m == 12) & (d == 25)))


@check(
    "j9_holiday_flag",
    I.with_(I.DAILY, _HOLIDAY_SQL)
    + """SELECT station, d.date, CAST(h.date IS NOT NULL AS INTEGER) AS is_holiday
    FROM daily d LEFT JOIN holidays h ON h.date = d.date""",
)
def _(spark, sf):
    return stations.add_holidays(I.daily(spark, sf), _holidays(spark, sf)).select("station", "date", "is_holiday")


@check(
    "p14_calendar_split",
    I.with_(I.DAILY, I.SPLIT) + "SELECT station, date, split FROM split",
)
def _(spark, sf):
    return I.split(spark, sf).select("station", "date", "split")


@check(
    "a17_split_counts",
    I.with_(I.DAILY, I.SPLIT)
    + """SELECT station, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
      count(*) FILTER (split = 'test') AS test FROM split GROUP BY station""",
)
def _(spark, sf):
    return splits.split_counts(I.split(spark, sf))


@check(
    "p18_warm_up_drop",
    I.with_(I.DAILY)
    + f", l AS (SELECT station, date, lag(aqi, 30) OVER w AS v FROM daily {_W}) SELECT station, date, round(v, 6) AS lag_aqi_30 FROM l WHERE v IS NOT NULL",
)
def _(spark, sf):
    out = plan.drop_warm_up(history.add_lags(I.daily(spark, sf), ["aqi"], [30], I.timeline()))
    return I.rounded(out.select("station", "date", "lag_aqi_30"), ["lag_aqi_30"])


def feature_table(spark, sf, rows=None):
    """All features of ``rows``, or else of the stored daily readings."""
    rows = I.stored_daily(spark, sf) if rows is None else rows
    return plan.build_features(
        rows, I.CODES, I.TRAIN_END, I.VAL_END, _holidays(spark, sf), timeline=I.timeline()
    )


_FAMILY_COUNTS = {
    "raw_pollutants": 9, "lag": 54, "rolling": 104, "interaction": 12, "station": 12,
    "temporal_cyclical": 8, "temporal_season_ohe": 5, "temporal_events": 6, "temporal_calendar": 7,
}


@check(
    "p19_feature_inventory",
    I.with_(I.DAILY)
    + f""", l AS (SELECT lag(aqi, 30) OVER w AS v FROM daily {_W}), n AS (SELECT count(*) AS rows FROM l WHERE v IS NOT NULL)
    SELECT family, CAST(features AS BIGINT) AS features, rows AS most_known FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _FAMILY_COUNTS.items())}) t(family, features), n""",
)
def _(spark, sf):
    listed = plan.inventory(feature_table(spark, sf))
    return listed.groupBy("family").agg(
        F.count("feature").alias("features"), F.max("known").alias("most_known")
    )


_F_NAMES = [
    "lag_aqi_1", "lag_pm25_7", "roll_mean_aqi_7", "roll_std_aqi_7", "roll_median_pm10_14", "roll_trend_aqi_30",
    "roll_aqi_momentum", "interact_lag_aqi1_winter", "station_mean_aqi", "station_season_mean_winter",
]


@check(
    "feature_table",
    I.with_(I.DAILY, I.SPLIT, _STATS_SQL)
    + f""", numbered AS (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS rn FROM split {_W}),
    looked AS (SELECT station, date, split, lag(aqi, 1) OVER w AS lag_aqi_1, lag(pm25, 7) OVER w AS lag_pm25_7, lag(aqi, 30) OVER w AS l30,
      avg(aqi) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3, avg(aqi) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7,
      stddev_samp(aqi) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7,
      median(pm10) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS d14,
      CASE WHEN count(aqi) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) = 30
        THEN regr_slope(aqi, rn) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS t30 FROM numbered {_W})
    SELECT l.station, l.date, l.split, round(lag_aqi_1, 6) AS lag_aqi_1, round(lag_pm25_7, 6) AS lag_pm25_7, round(m7, 6) AS roll_mean_aqi_7,
      round(s7, 6) AS roll_std_aqi_7, round(d14, 6) AS roll_median_pm10_14, round(t30, 6) AS roll_trend_aqi_30,
      round(m3 - m7, 4) AS roll_aqi_momentum,
      round(lag_aqi_1 * CASE WHEN month(l.date) IN (11, 12, 1, 2) THEN 1 ELSE 0 END, 4) AS interact_lag_aqi1_winter,
      station_mean_aqi, station_season_mean_winter
    FROM looked l JOIN stats USING (station) JOIN seasonal USING (station) WHERE l30 IS NOT NULL""",
)
def _(spark, sf):
    return I.rounded(feature_table(spark, sf).select("station", "date", "split", *_F_NAMES), _F_NAMES)
