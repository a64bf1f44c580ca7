"""Fences, completeness, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.operators import fences, quality

from . import inputs as I
from .registry import check

_COLS = ["aqi", "pm25"]
_LONG = """
long AS (SELECT station, 'aqi' AS variable, aqi AS value FROM gappy
  UNION ALL SELECT station, 'pm25', pm25 FROM gappy)"""
_BASE = I.with_(I.READINGS, I.GAPPY, _LONG)
_LIMITS = """
limits AS (SELECT * FROM (VALUES ('aqi', 0.0::DOUBLE, 500.0::DOUBLE), ('pm25', 0.0, 1000.0)) t(variable, low, high))"""


def _fence_sql(lower: str, upper: str, stats: str) -> str:
    return (
        _BASE
        + f""", {_LIMITS.strip()}, stats AS ({stats})
    SELECT s.station, s.variable, round(greatest({lower}, low), 6) AS lower, round(least({upper}, high), 6) AS upper
    FROM stats s JOIN limits USING (variable) WHERE n >= 20"""
    )


_IQR = _fence_sql(
    "q1 - 3 * (q3 - q1)",
    "q3 + 3 * (q3 - q1)",
    """SELECT station, variable, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
    FROM long GROUP BY 1, 2""",
)
_Z = _fence_sql(
    "m - 1.5 * s",
    "m + 1.5 * s",
    "SELECT station, variable, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY 1, 2",
).replace("FROM stats s JOIN", "FROM stats s JOIN")
_MOD = _fence_sql(
    "CASE WHEN mad = 0 THEN q1 - 3 * (q3 - q1) ELSE med - 3 * 1.167 * mad / 0.6745 END",
    "CASE WHEN mad = 0 THEN q3 + 3 * (q3 - q1) ELSE med + 3 * 1.167 * mad / 0.6745 END",
    """SELECT l.station, l.variable, count(l.value) AS n, any_value(med) AS med, any_value(q1) AS q1, any_value(q3) AS q3,
      quantile_cont(abs(l.value - med), 0.5) AS mad
    FROM long l JOIN (SELECT station, variable, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.25) AS q1,
      quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2) c
      ON c.station = l.station AND c.variable = l.variable GROUP BY 1, 2""",
)


def _fences(spark, sf, method, k=3.0):
    return fences.learn(I.gappy(spark, sf), _COLS, method, k)


@check("a11_iqr_fences", _IQR)
def _(spark, sf):
    return I.rounded(_fences(spark, sf, "iqr"), ["lower", "upper"])


@check("a12_zscore_fences", _Z)
def _(spark, sf):
    return I.rounded(_fences(spark, sf, "zscore", 1.5), ["lower", "upper"])


@check("a13_modified_zscore_fences", _MOD)
def _(spark, sf):
    return I.rounded(_fences(spark, sf, "modified_zscore"), ["lower", "upper"])


_DAILY_LONG = I.with_(I.DAILY) + """, long AS (
  SELECT station, 'pressure' AS variable, pressure AS value FROM daily UNION ALL
  SELECT station, 'humidity', humidity FROM daily UNION ALL
  SELECT station, 'spread', pm10 - pm25 FROM daily)"""


@check(
    "a14_physical_tightening",
    _DAILY_LONG
    + """, stats AS (SELECT station, variable, avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi
      FROM long GROUP BY 1, 2)
    SELECT station, variable,
      round(CASE variable WHEN 'pressure' THEN greatest(lo, 800.0) WHEN 'humidity' THEN greatest(lo, 0.0) ELSE lo END, 6) AS lower,
      round(CASE variable WHEN 'pressure' THEN least(hi, 1100.0) WHEN 'humidity' THEN least(hi, 100.0) ELSE hi END, 6) AS upper
    FROM stats""",
)
def _(spark, sf):
    d = I.daily(spark, sf).withColumn("spread", F.col("pm10") - F.col("pm25"))
    learned = fences.zscore_fences(d, ["pressure", "humidity", "spread"]).drop("n")
    return I.rounded(fences.tighten(learned), ["lower", "upper"])


_FENCED = _BASE + """, f AS (
  SELECT station, greatest(avg(aqi) - 1.5 * stddev_samp(aqi), 0.0) AS lo_aqi, least(avg(aqi) + 1.5 * stddev_samp(aqi), 500.0) AS hi_aqi,
    greatest(avg(pm25) - 1.5 * stddev_samp(pm25), 0.0) AS lo_pm25, least(avg(pm25) + 1.5 * stddev_samp(pm25), 1000.0) AS hi_pm25
  FROM gappy GROUP BY station), joined AS (SELECT * FROM gappy JOIN f USING (station))
"""


@check(
    "a15_outlier_summary",
    _FENCED
    + """SELECT station, 'aqi' AS variable, round(any_value(lo_aqi), 3) AS lower_bound, round(any_value(hi_aqi), 3) AS upper_bound,
      count(*) FILTER (aqi < lo_aqi OR aqi > hi_aqi) AS treated FROM joined GROUP BY 1
    UNION ALL SELECT station, 'pm25', round(any_value(lo_pm25), 3), round(any_value(hi_pm25), 3),
      count(*) FILTER (pm25 < lo_pm25 OR pm25 > hi_pm25) FROM joined GROUP BY 1""",
)
def _(spark, sf):
    g = I.gappy(spark, sf)
    return fences.summary(g, _fences(spark, sf, "zscore", 1.5), _COLS)


@check(
    "p20_cap_outliers",
    _FENCED
    + """SELECT event_id, round(CASE WHEN aqi IS NOT NULL THEN least(greatest(aqi, lo_aqi), hi_aqi) END, 6) AS aqi,
      round(CASE WHEN pm25 IS NOT NULL THEN least(greatest(pm25, lo_pm25), hi_pm25) END, 6) AS pm25 FROM joined""",
)
def _(spark, sf):
    out = fences.apply(I.gappy(spark, sf), _fences(spark, sf, "zscore", 1.5), _COLS, "cap")
    return I.rounded(out.select("event_id", *_COLS), _COLS)


@check(
    "p20_null_outliers",
    _FENCED
    + """SELECT event_id, round(CASE WHEN aqi BETWEEN lo_aqi AND hi_aqi THEN aqi END, 6) AS aqi,
      round(CASE WHEN pm25 BETWEEN lo_pm25 AND hi_pm25 THEN pm25 END, 6) AS pm25 FROM joined""",
)
def _(spark, sf):
    out = fences.apply(I.gappy(spark, sf), _fences(spark, sf, "zscore", 1.5), _COLS, "nan")
    return I.rounded(out.select("event_id", *_COLS), _COLS)


@check(
    "p20_drop_outlier_rows",
    _FENCED
    + """SELECT event_id, round(aqi, 6) AS aqi, round(pm25, 6) AS pm25 FROM joined
    WHERE NOT coalesce(aqi < lo_aqi OR aqi > hi_aqi, false) AND NOT coalesce(pm25 < lo_pm25 OR pm25 > hi_pm25, false)""",
)
def _(spark, sf):
    out = fences.apply(I.gappy(spark, sf), _fences(spark, sf, "zscore", 1.5), _COLS, "drop")
    return I.rounded(out.select("event_id", *_COLS), _COLS)


@check(
    "a16_upper_tail_outliers",
    _BASE
    + """, q AS (SELECT variable, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS t
      FROM long GROUP BY 1)
    SELECT variable, round(any_value(t), 6) AS threshold, count(*) FILTER (value > t) AS outliers
    FROM long JOIN q USING (variable) GROUP BY 1""",
)
def _(spark, sf):
    return I.rounded(fences.upper_tail(I.gappy(spark, sf), _COLS), ["threshold"])


_RUNS = """
flags AS (SELECT station, variable, date, value IS NULL AS missing,
    row_number() OVER (PARTITION BY station, variable ORDER BY date)
    - row_number() OVER (PARTITION BY station, variable, value IS NULL ORDER BY date) AS island
  FROM glong),
runs AS (SELECT station, variable, count(*) AS len FROM flags WHERE missing GROUP BY station, variable, island),
longest AS (SELECT station, variable, max(len) AS longest_run FROM runs GROUP BY 1, 2)"""
_GLONG = """
glong AS (SELECT station, date, 'aqi' AS variable, aqi AS value FROM hourly
  UNION ALL SELECT station, date, 'pm25', pm25 FROM hourly)"""
_HBASE = I.with_(I.READINGS, I.GAPPY, I.HOURLY, _GLONG, _RUNS)


@check(
    "w11_longest_null_run",
    _HBASE
    + """SELECT station, variable, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run
    FROM (SELECT DISTINCT station, variable FROM glong) LEFT JOIN longest USING (station, variable)""",
)
def _(spark, sf):
    return quality.longest_null_runs(I.hourly(spark, sf), _COLS, I.timeline())


@check(
    "a3_missing_report",
    _HBASE
    + """, counts AS (SELECT station, variable, count(*) FILTER (value IS NULL) AS missing, count(*) AS n FROM glong GROUP BY 1, 2)
    SELECT station, variable, missing, round(missing * 100.0::DOUBLE / n, 2) AS missing_pct,
      CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run,
      round(greatest(0.0, 100.0 - 2.0 * (missing * 100.0::DOUBLE / n) - 0.5 * coalesce(longest_run, 0)), 1) AS score
    FROM counts LEFT JOIN longest USING (station, variable)""",
)
def _(spark, sf):
    return quality.missing_report(I.hourly(spark, sf), _COLS, I.timeline())


_SCORES = """
scores AS (SELECT station, variable, round(60.0::DOUBLE * (count(value) / count(*)::DOUBLE)
    + 40.0::DOUBLE * (count(*) FILTER (value BETWEEN low AND high) / count(value)::DOUBLE), 1) AS score
  FROM glong JOIN limits USING (variable) GROUP BY 1, 2)"""
_TIGHT_LIMITS = _LIMITS


@check(
    "a4_column_scores",
    I.with_(I.READINGS, I.GAPPY, I.HOURLY, _GLONG, _LIMITS, _SCORES)
    + "SELECT station, variable, score FROM scores",
)
def _(spark, sf):
    return quality.column_scores(I.hourly(spark, sf), _COLS)


@check(
    "a4_overall_score",
    I.with_(I.READINGS, I.GAPPY, I.HOURLY, _GLONG, _LIMITS, _SCORES)
    + """, cover AS (SELECT station, count(*) * 100.0::DOUBLE / (date_diff('hour', min(date), max(date)) + 1) AS c FROM hourly GROUP BY 1)
    SELECT station, round(any_value(c), 4) AS coverage_pct, round(0.70::DOUBLE * avg(score) + 0.30::DOUBLE * any_value(c), 1) AS overall
    FROM scores JOIN cover USING (station) GROUP BY station""",
)
def _(spark, sf):
    return quality.overall_score(I.hourly(spark, sf), _COLS, "HOUR")


@check(
    "a5_class_distribution",
    I.with_(I.DAILY)
    + """, classes AS (SELECT * FROM (VALUES (0, 'Good'), (1, 'Satisfactory'), (2, 'Moderate'), (3, 'Poor'), (4, 'Very Poor'),
      (5, 'Severe')) t(class, label)),
    graded AS (SELECT station, CASE WHEN aqi <= 50 THEN 0 WHEN aqi <= 100 THEN 1 WHEN aqi <= 200 THEN 2 WHEN aqi <= 300 THEN 3
      WHEN aqi <= 400 THEN 4 ELSE 5 END AS class FROM daily),
    totals AS (SELECT station, count(*) AS t FROM graded GROUP BY 1)
    SELECT station, class, label, count(g.class) AS n, round(count(g.class) * 100.0::DOUBLE / any_value(t), 1) AS pct
    FROM totals CROSS JOIN classes LEFT JOIN graded g USING (station, class) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return quality.class_distribution(I.daily(spark, sf))


@check(
    "a7_quality_check",
    _BASE
    + """SELECT variable, count(*) FILTER (value IS NULL) AS missing,
      round(count(*) FILTER (value IS NULL) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
      count(*) FILTER (value < 0 OR value > CASE variable WHEN 'aqi' THEN 500 ELSE 1000 END) AS out_of_range,
      round(count(*) FILTER (value < 0 OR value > CASE variable WHEN 'aqi' THEN 500 ELSE 1000 END) * 100.0::DOUBLE / count(value), 2)
        AS out_of_range_pct,
      round(min(value), 3) AS min, round(max(value), 3) AS max, round(avg(value), 3) AS mean,
      CAST(count(value) / count(*)::DOUBLE >= 0.85 AS INTEGER) AS passed
    FROM long GROUP BY variable""",
)
def _(spark, sf):
    return quality.quality_check(I.gappy(spark, sf), _COLS, min_valid=0.85)


@check(
    "w12_time_gaps",
    I.with_(I.READINGS)
    + """, steps AS (SELECT station, CAST(floor((epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY station ORDER BY date))) / 1000000)
      AS BIGINT) AS s FROM readings)
    SELECT station, count(*) FILTER (s > 3 * 1200) AS gaps, max(s) AS longest_step_seconds FROM steps GROUP BY 1""",
)
def _(spark, sf):
    return quality.time_gaps(I.readings(spark, sf), 1200, I.timeline())


@check(
    "w12_out_of_order",
    """WITH e AS (SELECT event_type AS station, event_id, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events)
    SELECT station, count(*) FILTER (ts < p) AS out_of_order, CAST(count(*) FILTER (ts < p) = 0 AS INTEGER) AS monotonic
    FROM e GROUP BY 1""",
)
def _(spark, sf):
    return quality.out_of_order(I.readings(spark, sf), "event_id")


@check(
    "a33_extraction_report",
    I.with_(I.READINGS, I.GAPPY)
    + """, d AS (SELECT station, CAST(date AS DATE) AS date, aqi, pm25 FROM gappy),
    heads AS (SELECT station, count(*) AS rows, count(*) - count(DISTINCT date) AS duplicate_dates, min(date) AS first_date,
      max(date) AS last_date FROM d GROUP BY 1)
    SELECT h.*, 'aqi' AS variable, x.nulls, x.min, x.max, x.mean FROM heads h JOIN (SELECT station,
      count(*) FILTER (aqi IS NULL) AS nulls, round(min(aqi), 2) AS min, round(max(aqi), 2) AS max, round(avg(aqi), 2) AS mean
      FROM d GROUP BY 1) x USING (station)
    UNION ALL
    SELECT h.*, 'pm25', x.nulls, x.min, x.max, x.mean FROM heads h JOIN (SELECT station,
      count(*) FILTER (pm25 IS NULL) AS nulls, round(min(pm25), 2) AS min, round(max(pm25), 2) AS max, round(avg(pm25), 2) AS mean
      FROM d GROUP BY 1) x USING (station)""",
)
def _(spark, sf):
    d = I.gappy(spark, sf).withColumn("date", F.col("date").cast("date"))
    return quality.extraction_report(d, _COLS)


@check(
    "w13_duplicate_counts",
    """SELECT event_type AS station, count(*) AS rows, count(*) - count(DISTINCT CAST(ts AS DATE)) AS duplicates
    FROM events GROUP BY 1""",
)
def _(spark, sf):
    from breezeframe.operators.dedupe import duplicate_counts

    d = I.readings(spark, sf).withColumn("date", F.col("date").cast("date"))
    return duplicate_counts(d)
