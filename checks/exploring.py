"""Exploratory statistics, selections and naive-forecast scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.operators import explore, history, scores, splits

from . import inputs as I
from .registry import check

_SEASON = """CASE WHEN month(date) IN (11, 12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4) THEN 'Spring'
  WHEN month(date) IN (5, 6) THEN 'Summer' WHEN month(date) IN (7, 8, 9) THEN 'Monsoon' ELSE 'Post_Monsoon' END"""
_A, _B = "1-URGENT", "2-HIGH"
_DESC = ["aqi", "pm25", "pm10"]


@check(
    "a2_descriptive_statistics",
    I.with_(I.DAILY)
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT station, '{c}' AS variable, {c} AS v FROM daily" for c in _DESC)
    + """) SELECT station, variable, count(v) AS count, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 3) AS min,
      round(quantile_cont(v, 0.25), 3) AS p25, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_cont(v, 0.75), 3) AS p75,
      round(max(v), 3) AS max, round(skewness(v), 3) AS skew FROM long GROUP BY 1, 2""",
)
def _(spark, sf):
    return explore.describe(I.daily(spark, sf), _DESC)


@check(
    "p12_select_years_and_station",
    I.with_(I.DAILY)
    + f"SELECT station, date, round(aqi, 6) AS aqi FROM daily WHERE year(date) BETWEEN 1996 AND 1998 AND station = '{_A}'",
)
def _(spark, sf):
    picked = explore.select_years(I.daily(spark, sf), 1996, 1998, [_A])
    return I.rounded(picked.select("station", "date", "aqi"), ["aqi"])


@check(
    "a18_monthly_means",
    I.with_(I.DAILY)
    + """SELECT station, CAST(month(date) AS INTEGER) AS month, round(avg(pm25), 6) AS pm25, round(avg(pm10), 6) AS pm10, round(avg(no2), 6) AS no2
    FROM daily GROUP BY GROUPING SETS ((station, month(date)), (month(date)))""",
)
def _(spark, sf):
    out = explore.monthly_means(I.daily(spark, sf), ["pm25", "pm10", "no2"])
    return I.rounded(out, ["pm25", "pm10", "no2"])


@check(
    "a18_monthly_pattern",
    I.with_(I.READINGS)
    + """, names AS (SELECT unnest(range(1, 13)) AS m, unnest(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']) AS month),
    v AS (SELECT station, month(date) AS m, avg(aqi) AS a FROM readings GROUP BY 1, 2)
    SELECT s.station, n.month, round(coalesce(a, 150.0), 1) AS aqi FROM (SELECT DISTINCT station FROM readings) s CROSS JOIN names n
    LEFT JOIN v ON v.station = s.station AND v.m = n.m""",
)
def _(spark, sf):
    return explore.monthly_pattern(I.readings(spark, sf))


@check(
    "a20_seasonal_pattern_with_defaults",
    I.with_(I.DAILY)
    + f""", d AS (SELECT station || ' ' || CAST(quarter(date) AS VARCHAR) AS station, {_SEASON} AS season, aqi FROM daily),
    names AS (SELECT * FROM (VALUES ('Winter', 280.0::DOUBLE), ('Spring', 140.0), ('Summer', 160.0), ('Monsoon', 90.0), ('Post_Monsoon', 200.0)) t(season, v)),
    m AS (SELECT station, season, avg(aqi) AS aqi FROM d GROUP BY 1, 2)
    SELECT s.station, n.season, round(coalesce(m.aqi, n.v), 1) AS aqi FROM (SELECT DISTINCT station FROM d) s CROSS JOIN names n
    LEFT JOIN m ON m.station = s.station AND m.season = n.season""",
)
def _(spark, sf):
    """Stations are cut by quarter, so that each lacks seasons."""
    quarters = I.daily(spark, sf).withColumn("station", F.concat_ws(" ", "station", F.quarter("date").cast("string")))
    return explore.seasonal_pattern(quarters)


@check(
    "a20_seasonal_statistics",
    I.with_(I.DAILY)
    + f"""SELECT {_SEASON} AS season, station, round(avg(aqi), 6) AS mean, round(stddev_samp(aqi), 6) AS std, round(min(aqi), 6) AS min,
      round(max(aqi), 6) AS max FROM daily GROUP BY 1, 2""",
)
def _(spark, sf):
    return I.rounded(explore.seasonal_stats(I.daily(spark, sf)), ["mean", "std", "min", "max"])


@check(
    "a21_annual_trend",
    I.with_(I.DAILY)
    + f"""SELECT CAST(year(date) AS INTEGER) AS year, round(avg(aqi) FILTER (station = '{_A}'), 6) AS first, round(avg(aqi) FILTER (station = '{_B}'), 6) AS second,
      round(avg(aqi) FILTER (station = '{_A}') - avg(aqi) FILTER (station = '{_B}'), 6) AS difference FROM daily GROUP BY 1""",
)
def _(spark, sf):
    out = explore.annual_trend(I.daily(spark, sf), [_A, _B])
    named = out.withColumnsRenamed({_A: "first", _B: "second"})
    return I.rounded(named, ["first", "second", "difference"])


_MONTHS = [f"m{m}" for m in range(1, 13)]


@check(
    "a22_year_month_heatmap",
    I.with_(I.DAILY)
    + "SELECT CAST(year(date) AS INTEGER) AS year, "
    + ", ".join(f"round(avg(aqi) FILTER (month(date) = {m}), 6) AS m{m}" for m in range(1, 13))
    + " FROM daily GROUP BY 1",
)
def _(spark, sf):
    return I.rounded(explore.heatmap(I.daily(spark, sf)), _MONTHS)


_PAIR = ["aqi", "pm25", "pm10", "temperature", "humidity"]


def _pearson_sql(key: str) -> str:
    pre, grp = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    parts = [
        f"SELECT {pre}'{a}' AS x, '{b}' AS y, round({'1.0' if a == b else f'corr({a}, {b})'}, 6) AS r FROM daily {grp or 'LIMIT 1' if a == b else grp}"
        for a in _PAIR
        for b in _PAIR
    ]
    return I.with_(I.DAILY) + " UNION ALL ".join(f"(SELECT * FROM ({p}))" for p in parts)


@check("a25_pearson_matrix", _pearson_sql("").replace("FROM daily LIMIT 1", "FROM (SELECT 1)"))
def _(spark, sf):
    return I.rounded(explore.pearson(I.daily(spark, sf), _PAIR), ["r"])


@check("a25_pearson_matrix_by_station", _pearson_sql("station"))
def _(spark, sf):
    return I.rounded(explore.pearson(I.daily(spark, sf), _PAIR, by_station=True), ["r"])


_LAG_FEATURES = [f"lag_{c}_{k}" for c in ("aqi", "pm25") for k in (1, 7, 30)]
_LAGS_SQL = I.with_(I.DAILY) + ", l AS (SELECT station, aqi, " + ", ".join(
    f"lag({c}, {k}) OVER w AS lag_{c}_{k}" for c in ("aqi", "pm25") for k in (1, 7, 30)
) + " FROM daily WINDOW w AS (PARTITION BY station ORDER BY date))"


def _corr_sql(key: str) -> str:
    pre, grp = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return _LAGS_SQL + " UNION ALL ".join(
        f" SELECT '{f}' AS feature, {pre}round(corr(aqi, {f}), 4) AS pearson_r, round(abs(corr(aqi, {f})), 4) AS abs_r FROM l {grp} HAVING count({f}) >= 10"
        for f in _LAG_FEATURES
    )


def _lag_rows(spark, sf):
    return history.add_lags(I.daily(spark, sf), ["aqi", "pm25"], [1, 7, 30], I.timeline())


@check("a26_lag_correlations", _corr_sql("station"))
def _(spark, sf):
    return explore.correlations(_lag_rows(spark, sf), _LAG_FEATURES)


@check("a27_feature_correlations", _corr_sql(""))
def _(spark, sf):
    return explore.correlations(_lag_rows(spark, sf), _LAG_FEATURES, by_station=False)


@check(
    "a28_autocorrelation",
    I.with_(I.DAILY)
    + ", l AS (SELECT station, aqi, "
    + ", ".join(f"lag(aqi, {k}) OVER w AS l{k}" for k in history.ACF_LAGS)
    + " FROM daily WINDOW w AS (PARTITION BY station ORDER BY date)) SELECT station, "
    + ", ".join(f"round(corr(aqi, l{k}), 6) AS lag_{k}" for k in history.ACF_LAGS)
    + " FROM l GROUP BY 1",
)
def _(spark, sf):
    out = history.autocorrelation(I.daily(spark, sf), timeline=I.timeline())
    return I.rounded(out, [f"lag_{k}" for k in history.ACF_LAGS])


_PERIODS = {
    "before": ("1996-03-01", "1996-06-30"),
    "during": ("1997-03-01", "1997-06-30"),
    "after": ("1998-03-01", "1998-06-30"),
    "all_years": ("1996-01-01", "1998-12-31"),
}


@check(
    "a29_period_comparison",
    I.with_(I.DAILY)
    + " UNION ALL ".join(
        f" SELECT '{n}' AS period, round(avg(aqi), 6) AS aqi, round(avg(pm25), 6) AS pm25 FROM daily WHERE date BETWEEN DATE '{a}' AND DATE '{b}'"
        for n, (a, b) in _PERIODS.items()
    ),
)
def _(spark, sf):
    return I.rounded(explore.compare_periods(I.daily(spark, sf), _PERIODS, ["aqi", "pm25"]), ["aqi", "pm25"])


@check(
    "a29_period_drop",
    I.with_(I.DAILY)
    + """, m AS (SELECT station, avg(aqi) FILTER (date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30') AS before,
      avg(aqi) FILTER (date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30') AS during FROM daily GROUP BY 1)
    SELECT station, round(before, 6) AS before, round(during, 6) AS during, round((before - during) * 100 / before, 6) AS drop_pct FROM m""",
)
def _(spark, sf):
    out = explore.drop_between(I.daily(spark, sf), _PERIODS["before"], _PERIODS["during"])
    return I.rounded(out, ["before", "during", "drop_pct"])


@check(
    "a30_yearly_slope",
    I.with_(I.DAILY)
    + """SELECT station, round(regr_slope(aqi, date_diff('day', DATE '2000-01-01', date) / 365.25::DOUBLE), 6) AS slope_per_year
    FROM daily GROUP BY 1""",
)
def _(spark, sf):
    return I.rounded(explore.yearly_slope(I.daily(spark, sf)), ["slope_per_year"])


@check(
    "a31_summary_facts",
    I.with_(I.DAILY)
    + """, f AS (SELECT count(*)::DOUBLE AS rows, count(DISTINCT station)::DOUBLE AS stations, avg(aqi) AS aqi_mean, stddev_samp(aqi) AS aqi_std,
      min(aqi) AS aqi_min, max(aqi) AS aqi_max, (count(*) FILTER (aqi = 500))::DOUBLE AS saturated, min(year(date))::DOUBLE AS first_year,
      max(year(date))::DOUBLE AS last_year, corr(pm25, aqi) AS r_pm25_aqi, corr(temperature, aqi) AS r_temperature_aqi FROM daily)
    SELECT metric, round(value, 6) AS value FROM (UNPIVOT f ON COLUMNS(*) INTO NAME metric VALUE value)""",
)
def _(spark, sf):
    out = explore.summary_facts(I.daily(spark, sf), [("pm25", "aqi"), ("temperature", "aqi")])
    return I.rounded(out, ["value"])


@check(
    "a32_selection_kpis",
    I.with_(I.DAILY)
    + "SELECT count(aqi) AS n, round(avg(aqi), 6) AS mean, round(max(aqi), 6) AS max, round(min(aqi), 6) AS min FROM daily WHERE year(date) = 1997",
)
def _(spark, sf):
    return I.rounded(explore.kpis(explore.select_years(I.daily(spark, sf), 1997, 1997)), ["max", "min"])


@check(
    "a37_season_distribution",
    I.with_(I.DAILY)
    + f"""SELECT {_SEASON} AS season, station, count(aqi) AS n, round(quantile_cont(aqi, 0.25), 6) AS q1, round(median(aqi), 6) AS median,
      round(quantile_cont(aqi, 0.75), 6) AS q3, round(min(aqi), 6) AS min, round(max(aqi), 6) AS max FROM daily GROUP BY 1, 2
      HAVING count(aqi) >= 5""",
)
def _(spark, sf):
    return I.rounded(
        explore.season_distribution(I.daily(spark, sf)), ["q1", "median", "q3", "min", "max"]
    )


@check(
    "a41_latest_per_station",
    I.with_(I.DAILY)
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date DESC) AS rn FROM daily)
    SELECT station, date, round(aqi, 6) AS aqi, round(pm25, 6) AS pm25, CASE WHEN pm25 > 0.6 * pm10 THEN 'PM2.5' ELSE 'PM10' END AS main_pollutant,
      CASE WHEN aqi <= 50 THEN 'Minimal' WHEN aqi <= 100 THEN 'Slight' WHEN aqi <= 200 THEN 'Moderate' WHEN aqi <= 300 THEN 'High'
      ELSE 'Severe' END AS risk FROM ranked WHERE rn = 1""",
)
def _(spark, sf):
    out = explore.latest_per_station(I.daily(spark, sf))
    return I.rounded(out.select("station", "date", "aqi", "pm25", "main_pollutant", "risk"), ["aqi", "pm25"])


@check(
    "a42_percentile_clip",
    I.with_(I.DAILY)
    + """, q AS (SELECT quantile_cont(aqi, 0.05) AS la, quantile_cont(aqi, 0.95) AS ha, quantile_cont(pm25, 0.05) AS lp,
      quantile_cont(pm25, 0.95) AS hp FROM daily)
    SELECT station, date, round((least(greatest(aqi, la), ha) - la) / (ha - la), 6) AS aqi_norm,
      round((least(greatest(pm25, lp), hp) - lp) / (hp - lp), 6) AS pm25_norm FROM daily, q""",
)
def _(spark, sf):
    out = explore.clip_normalise(I.daily(spark, sf), ["aqi", "pm25"])
    return I.rounded(out.select("station", "date", "aqi_norm", "pm25_norm"), ["aqi_norm", "pm25_norm"])


@check(
    "k1_sorted_series",
    I.with_(I.DAILY) + "SELECT station, date, round(aqi, 6) AS aqi FROM daily ORDER BY station, date",
)
def _(spark, sf):
    return I.rounded(explore.sort_series(I.daily(spark, sf).select("station", "date", "aqi")), ["aqi"])


@check(
    "k2_top_pollution_days",
    I.with_(I.DAILY)
    + "SELECT station, date, round(aqi, 6) AS aqi, round(pm25, 6) AS pm25 FROM daily ORDER BY daily.aqi DESC, date, station LIMIT 10",
)
def _(spark, sf):
    return I.rounded(
        explore.top_days(I.daily(spark, sf), 10).select("station", "date", "aqi", "pm25"), ["aqi", "pm25"]
    )


@check(
    "k5_latest_rows",
    I.with_(I.DAILY) + "SELECT station, date, round(aqi, 6) AS aqi FROM daily ORDER BY date DESC, station LIMIT 50",
)
def _(spark, sf):
    return I.rounded(explore.latest_rows(I.daily(spark, sf), 50).select("station", "date", "aqi"), ["aqi"])


@check(
    "k5_last_rows_per_station",
    I.with_(I.DAILY)
    + """SELECT station, date, round(aqi, 6) AS aqi FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date DESC) AS rn FROM daily)
    WHERE rn <= 20""",
)
def _(spark, sf):
    out = history.last_rows(I.daily(spark, sf), 20, I.timeline())
    return I.rounded(out.select("station", "date", "aqi"), ["aqi"])


@check(
    "w14_trailing_summary",
    I.with_(I.DAILY)
    + """, r AS (SELECT station, aqi, row_number() OVER (PARTITION BY station ORDER BY date DESC) AS rn FROM daily)
    SELECT station, round(avg(aqi) FILTER (rn <= 3), 6) AS roll_3, round(avg(aqi) FILTER (rn <= 7), 6) AS roll_7,
      round(avg(aqi) FILTER (rn <= 30), 6) AS roll_30,
      string_agg(CAST(CAST(floor(round(aqi, 1) * 10 + 0.5) AS BIGINT) AS VARCHAR), ' ' ORDER BY rn DESC) FILTER (rn <= 7) AS recent
    FROM r GROUP BY 1""",
)
def _(spark, sf):
    out = history.trailing_summary(I.daily(spark, sf), timeline=I.timeline())
    tenths = F.transform("recent", lambda v: F.floor(v * 10 + 0.5).cast("string"))
    return I.rounded(out.withColumn("recent", F.concat_ws(" ", tenths)), ["roll_3", "roll_7", "roll_30"])


def _centred(n: int) -> str:
    back, ahead = n // 2, (n + 1) // 2 - 1
    w = f"(PARTITION BY station ORDER BY date ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    return I.with_(I.DAILY) + f"SELECT station, date, round(CASE WHEN count(aqi) OVER {w} = {n} THEN avg(aqi) OVER {w} END, 6) AS centred_aqi_{n} FROM daily"


@check("w17_centred_mean_30", _centred(30))
def _(spark, sf):
    out = history.centred_mean(I.daily(spark, sf), "aqi", 30, I.timeline())
    return I.rounded(out.select("station", "date", "centred_aqi_30"), ["centred_aqi_30"])


@check("w17_centred_mean_7", _centred(7))
def _(spark, sf):
    out = history.centred_mean(I.daily(spark, sf), "aqi", 7, I.timeline())
    return I.rounded(out.select("station", "date", "centred_aqi_7"), ["centred_aqi_7"])


_SPLIT_SQL = """
numbered AS (SELECT station, date, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS pos,
    count(*) OVER (PARTITION BY station) AS n FROM daily),
cuts AS (SELECT *, n - CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS ts, CAST(floor(n * 0.10::DOUBLE) AS BIGINT) AS vn FROM numbered),
labelled AS (SELECT station, date, CASE WHEN pos < ts - 24 - vn - 24 THEN 'train'
    WHEN pos >= ts - 24 - vn AND pos < ts - 24 THEN 'val' WHEN pos >= ts THEN 'test' END AS split FROM cuts)"""


@check(
    "w16_gap_split",
    I.with_(I.DAILY, _SPLIT_SQL) + "SELECT station, date, split FROM labelled WHERE split IS NOT NULL",
)
def _(spark, sf):
    out = splits.gap_split(I.daily(spark, sf).select("station", "date"), timeline=I.timeline())
    return out.select("station", "date", "split")


@check(
    "j10_split_disjointness",
    I.with_(I.DAILY, _SPLIT_SQL)
    + """SELECT count(*) AS shared FROM labelled a SEMI JOIN (SELECT station, date FROM labelled WHERE split = 'test') b
    ON a.station = b.station AND a.date = b.date WHERE a.split = 'train'""",
)
def _(spark, sf):
    out = splits.gap_split(I.daily(spark, sf).select("station", "date"), timeline=I.timeline())
    return splits.shared_keys(out.where("split = 'train'"), out.where("split = 'test'"))


_SEQ = ["aqi", "pm25", "temperature"]


@check(
    "w15_sliding_sequences",
    I.with_(I.DAILY, I.SPLIT)
    + ", s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SEQ)
    + " FROM split WHERE split = 'train'), z AS (SELECT station, date, aqi AS y, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in _SEQ)
    + """ FROM split, s), q AS (SELECT station, date, round(y, 6) AS target, count(*) OVER w AS n, """
    + ", ".join(
        f"round(first_value({c}) OVER w, 6) AS first_{c}, round(last_value({c}) OVER w, 6) AS last_{c}, round(sum({c}) OVER w, 5) AS sum_{c}"
        for c in _SEQ
    )
    + """ FROM z WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN 16 PRECEDING AND 3 PRECEDING))
    SELECT * EXCLUDE (n) FROM q WHERE n = 14""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    fitted = history.scaler(s.where("split = 'train'"), _SEQ)
    seq = history.sequences(s, _SEQ, "aqi", 14, 3, fitted, I.timeline())
    cols = {"target": F.round("target", 6)}
    for i, c in enumerate(_SEQ):
        one = _component("sequence", i)
        cols[f"first_{c}"] = F.round(F.get(one, F.lit(0)), 6)
        cols[f"last_{c}"] = F.round(F.get(one, F.lit(13)), 6)
        cols[f"sum_{c}"] = F.round(F.aggregate(one, F.lit(0.0), lambda a, v: a + v), 5)
    return seq.select("station", "date", *[c.alias(n) for n, c in cols.items()])


def _component(sequence: str, i: int):
    return F.transform(sequence, lambda v: v[i])


_P = I.with_(I.DAILY, I.SPLIT, I.LAGGED, I.PREDICTIONS)


@check(
    "m1_persistence_forecast",
    _P + "SELECT model, station, date, round(prediction, 6) AS prediction FROM predictions WHERE model <> 'seasonal_mean'",
)
def _(spark, sf):
    p = I.predictions(spark, sf).where("model <> 'seasonal_mean'")
    return I.rounded(p.select("model", "station", "date", "prediction"), ["prediction"])


@check(
    "m2_seasonal_mean_forecast",
    _P + "SELECT station, date, round(prediction, 6) AS prediction FROM predictions WHERE model = 'seasonal_mean'",
)
def _(spark, sf):
    p = I.predictions(spark, sf).where("model = 'seasonal_mean'")
    return I.rounded(p.select("station", "date", "prediction"), ["prediction"])


SCORE_SQL = """count(*) AS n, round(sqrt(avg((aqi - prediction) * (aqi - prediction))), 5) AS rmse,
  round(avg(abs(aqi - prediction)), 5) AS mae, round(avg(abs(aqi - prediction) / greatest(abs(aqi), 1e-8)) * 100, 5) AS mape,
  round(avg(abs(aqi - prediction) / ((abs(aqi) + abs(prediction)) / 2 + 1e-8)) * 100, 5) AS smape,
  round(1 - sum((aqi - prediction) * (aqi - prediction)) / (count(*) * var_pop(aqi)), 5) AS r2"""
SCORES_CTE = f"""
scores AS (SELECT model, split, coalesce(station, 'Combined') AS station, {SCORE_SQL} FROM predictions
  GROUP BY GROUPING SETS ((model, split, station), (model, split)))"""
_SCORES = I.with_(I.DAILY, I.SPLIT, I.LAGGED, I.PREDICTIONS, SCORES_CTE)


@check("a34_regression_scores", _SCORES + "SELECT * FROM scores")
def _(spark, sf):
    return I.rounded(scores.regression_scores(I.predictions(spark, sf)), list(scores.SCORES), 5)


@check(
    "w18_model_ranking",
    _SCORES
    + "SELECT model, split, station, rmse, row_number() OVER (PARTITION BY split, station ORDER BY rmse, model)::INTEGER AS rank FROM scores",
)
def _(spark, sf):
    ranked = scores.rank_models(I.rounded(scores.regression_scores(I.predictions(spark, sf)), ["rmse"], 5))
    return ranked.select("model", "split", "station", "rmse", "rank")


@check(
    "m10_overfit_gap",
    _SCORES
    + """, w AS (SELECT model, max(rmse) FILTER (split = 'train') AS rmse_train, max(rmse) FILTER (split = 'val') AS rmse_val,
      max(rmse) FILTER (split = 'test') AS rmse_test FROM scores WHERE station = 'Combined' GROUP BY 1)
    SELECT *, round(rmse_train - rmse_val, 4) AS overfit_gap FROM w""",
)
def _(spark, sf):
    s = I.rounded(scores.regression_scores(I.predictions(spark, sf)), ["rmse"], 5)
    return I.rounded(scores.overfit_gap(s), ["overfit_gap"], 4)


@check(
    "u2_join_result_tables",
    _SCORES
    + """SELECT model, split, station, rmse, r2, CASE WHEN model = 'seasonal_mean' THEN 'DL' ELSE 'ML' END AS family FROM scores""",
)
def _(spark, sf):
    s = I.rounded(scores.regression_scores(I.predictions(spark, sf)), ["rmse", "r2"], 5).select(
        "model", "split", "station", "rmse", "r2"
    )
    deep = s.where("model = 'seasonal_mean'").withColumnsRenamed({"rmse": "RMSE", "r2": "score"})
    return scores.join_result_tables(
        s.where("model <> 'seasonal_mean'"), deep, {"RMSE": "rmse", "score": "r2"}
    )


@check(
    "a35_residual_summary",
    _P
    + """, r AS (SELECT model, month(date) AS m, aqi - prediction AS r FROM predictions)
    SELECT model, round(avg(r), 6) AS bias, round(stddev_pop(r), 6) AS std, round(avg(r) - 2 * stddev_pop(r), 6) AS lower,
      round(avg(r) + 2 * stddev_pop(r), 6) AS upper, """
    + ", ".join(f"round(coalesce(avg(r) FILTER (m = {m}), 0.0), 6) AS m{m}" for m in range(1, 13))
    + " FROM r GROUP BY 1",
)
def _(spark, sf):
    out = scores.residual_summary(I.predictions(spark, sf))
    return I.rounded(out, ["bias", "std", "lower", "upper", *_MONTHS])


@check(
    "a36_residual_histogram",
    _P
    + """, r AS (SELECT model, aqi - prediction AS r FROM predictions),
    e AS (SELECT model, min(r) AS lo, (max(r) - min(r)) / 55 AS width FROM r GROUP BY 1)
    SELECT model, CAST(least(54, floor((r - lo) / width)) AS INTEGER) AS bin, count(*) AS n FROM r JOIN e USING (model) GROUP BY 1, 2""",
)
def _(spark, sf):
    return scores.residual_histogram(I.predictions(spark, sf))
