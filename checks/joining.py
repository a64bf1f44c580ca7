"""As-of, spatial, calendar and station joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.operators import asof, explore, spatial, spine

from . import inputs as I
from .registry import check

# Probes: every third part of a day for which a station reported, plus the readings' own times.
_PROBES = """
probes AS (SELECT user_id * 10000000 + event_id AS probe, event_type AS station,
    date_trunc('hour', ts) + INTERVAL 17 MINUTE AS date FROM events),
r AS (SELECT station, date, aqi, pm25 FROM readings)"""


def _probes(spark, sf):
    e = I.table(spark, sf, "events")
    return e.select(
        (F.col("user_id") * 10000000 + F.col("event_id")).alias("probe"),
        F.col("event_type").alias("station"),
        (F.date_trunc("HOUR", "ts") + F.expr("INTERVAL 17 MINUTE")).alias("date"),
    )


def _known(spark, sf):
    return I.readings(spark, sf).select("station", "date", "aqi", "pm25")


@check(
    "j4_nearest_reading",
    I.with_(I.READINGS, _PROBES)
    + """, back AS (SELECT p.probe, p.station, p.date, r.date AS d, r.aqi, r.pm25 FROM probes p ASOF LEFT JOIN r
      ON p.station = r.station AND p.date >= r.date),
    ahead AS (SELECT p.probe, r.date AS d, r.aqi, r.pm25 FROM probes p ASOF LEFT JOIN r ON p.station = r.station AND p.date <= r.date)
    SELECT b.probe, b.station, b.date, CASE WHEN keep THEN b.d ELSE a.d END AS matched_date,
      round(CASE WHEN keep THEN b.aqi ELSE a.aqi END, 6) AS aqi, round(CASE WHEN keep THEN b.pm25 ELSE a.pm25 END, 6) AS pm25
    FROM (SELECT back.*, a.d IS NULL OR (back.d IS NOT NULL AND date_diff('us', back.d, back.date) <= date_diff('us', back.date, a.d)) AS keep
      FROM back JOIN ahead a USING (probe)) b JOIN ahead a USING (probe)""",
)
def _(spark, sf):
    out = asof.nearest(_probes(spark, sf), _known(spark, sf), ["aqi", "pm25"], timeline=I.timeline())
    return I.rounded(out, ["aqi", "pm25"])


@check(
    "j5_last_rows_before",
    I.with_(I.READINGS, _PROBES)
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) AS pos, count(*) OVER (PARTITION BY station) AS total FROM r),
    k AS (SELECT p.probe, p.station, p.date, coalesce(n.pos, 0) AS k FROM probes p ASOF LEFT JOIN n
      ON p.station = n.station AND p.date > n.date),
    e AS (SELECT k.*, CASE WHEN k >= 7 THEN k ELSE total END AS last FROM k JOIN (SELECT DISTINCT station, total FROM n) USING (station))
    SELECT e.probe, e.station, e.date, CAST(e.last - n.pos + 1 AS INTEGER) AS back, n.date AS matched_date, round(n.aqi, 6) AS aqi
    FROM e JOIN n ON n.station = e.station AND n.pos BETWEEN e.last - 6 AND e.last""",
)
def _(spark, sf):
    out = asof.last_before(_probes(spark, sf), _known(spark, sf), 7, ["aqi"], timeline=I.timeline())
    return I.rounded(out, ["aqi"])


@check(
    "j3_two_stations_side_by_side",
    I.with_(I.DAILY)
    + """SELECT a.date, round(a.aqi, 6) AS aqi_a, round(a.pm25, 6) AS pm25_a, round(b.aqi, 6) AS aqi_b, round(b.pm25, 6) AS pm25_b
    FROM daily a JOIN daily b ON a.date = b.date AND a.station = '1-URGENT' AND b.station = '2-HIGH'""",
)
def _(spark, sf):
    out = explore.join_stations(I.daily(spark, sf), "1-URGENT", "2-HIGH", ["aqi", "pm25"])
    return I.rounded(out, ["aqi_a", "pm25_a", "aqi_b", "pm25_b"])


# Anchors are the stations with their places; targets are suppliers spread around them, and the anchors.
ANCHORS_SQL = "anchors AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {lat}::DOUBLE, {lon}::DOUBLE)" for s, (lat, lon) in I.PLACES.items()
) + ") t(station, lat, lon))"
_TARGETS = """
targets AS (SELECT CAST(s_suppkey AS VARCHAR) AS target, 28.4 + s_nationkey / 97.0::DOUBLE AS lat, 77.3 + s_acctbal / 50011.0::DOUBLE AS lon
  FROM supplier UNION ALL SELECT station, lat, lon FROM anchors),
pairs AS (SELECT target, a.station, (t.lat - a.lat) * (t.lat - a.lat) + (t.lon - a.lon) * (t.lon - a.lon) AS d2 FROM targets t, anchors a),
raw AS (SELECT target, station, CASE WHEN min(d2) OVER (PARTITION BY target) = 0 THEN CAST(d2 = 0 AS DOUBLE) ELSE 1 / d2 END AS w FROM pairs),
weights AS (SELECT target, station, w / sum(w) OVER (PARTITION BY target) AS weight FROM raw)"""


def anchors(spark, sf):
    """Station places for the stations that occur in the readings."""
    lat, lon = F.lit(None).cast("double"), F.lit(None).cast("double")
    for s, (a, b) in I.PLACES.items():
        lat = F.when(F.col("station") == s, F.lit(a)).otherwise(lat)
        lon = F.when(F.col("station") == s, F.lit(b)).otherwise(lon)
    names = I.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("station")).distinct()
    return names.select("station", lat.alias("lat"), lon.alias("lon"))


def _weights(spark, sf):
    suppliers = I.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("target"),
        (28.4 + F.col("s_nationkey") / 97.0).alias("lat"),
        (77.3 + F.col("s_acctbal") / 50011.0).alias("lon"),
    )
    places = anchors(spark, sf)
    targets = suppliers.unionByName(places.withColumnRenamed("station", "target"))
    return spatial.station_weights(targets, places)


@check(
    "j6_distance_weights",
    I.with_(ANCHORS_SQL, _TARGETS) + "SELECT target, station, round(weight, 6) AS weight FROM weights",
)
def _(spark, sf):
    return I.rounded(_weights(spark, sf), ["weight"])


@check(
    "j6_distance_blend",
    I.with_(I.DAILY, ANCHORS_SQL, _TARGETS)
    + """SELECT target, date, round(sum(weight * aqi) / sum(weight), 6) AS aqi, round(sum(weight * pm25) / sum(weight), 6) AS pm25
    FROM weights JOIN daily USING (station) WHERE weight > 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    out = spatial.blend(_weights(spark, sf), I.daily(spark, sf), ["aqi", "pm25"])
    return I.rounded(out, ["aqi", "pm25"])


@check(
    "a19_blended_monthly_pattern",
    I.with_(I.DAILY, ANCHORS_SQL, _TARGETS)
    + """, m AS (SELECT station, CAST(month(date) AS INTEGER) AS month, avg(aqi) AS aqi, avg(pm25) AS pm25 FROM daily GROUP BY 1, 2)
    SELECT target, month, round(sum(weight * aqi) / sum(weight), 4) AS aqi, round(sum(weight * pm25) / sum(weight), 4) AS pm25
    FROM weights JOIN m USING (station) WHERE weight > 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    return spatial.blended_monthly_pattern(_weights(spark, sf), I.daily(spark, sf), ["aqi", "pm25"], 4)


@check(
    "a23_climatology",
    I.with_(I.DAILY)
    + "SELECT CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, round(avg(aqi), 6) AS aqi FROM daily GROUP BY 1, 2",
)
def _(spark, sf):
    return I.rounded(spine.climatology(I.daily(spark, sf)), ["aqi"])


@check(
    "a24_daily_mean",
    I.with_(I.READINGS) + "SELECT CAST(date AS DATE) AS date, round(avg(aqi), 6) AS aqi FROM readings GROUP BY 1",
)
def _(spark, sf):
    return I.rounded(spine.daily_mean(I.readings(spark, sf)), ["aqi"])


@check(
    "j7_calendar_with_fallback",
    I.with_(I.DAILY)
    + """, part AS (SELECT * FROM daily WHERE station = '1-URGENT' AND NOT (month(date) = 2 AND day(date) = 29)),
    days AS (SELECT CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT DISTINCT year(date) AS y FROM part)),
    actual AS (SELECT date, avg(aqi) AS a FROM part GROUP BY 1),
    usual AS (SELECT month(date) AS m, day(date) AS d, avg(aqi) AS u FROM part GROUP BY 1, 2)
    SELECT days.date, CAST(dayofweek(days.date) AS INTEGER) AS day_of_week, CAST(month(days.date) - 1 AS INTEGER) AS month_index,
      CAST(floor(least(greatest(coalesce(a, u, 150.0), 15.0), 500.0)) AS INTEGER) AS aqi,
      CASE WHEN a IS NOT NULL THEN 'actual' WHEN u IS NOT NULL THEN 'climatology' ELSE 'default' END AS origin
    FROM days LEFT JOIN actual ON actual.date = days.date LEFT JOIN usual ON m = month(days.date) AND d = day(days.date)""",
)
def _(spark, sf):
    d = I.daily(spark, sf).where("station = '1-URGENT'")
    # Without leap days the default value is reached as well.
    return spine.year_calendar(d.where(~((F.month("date") == 2) & (F.dayofmonth("date") == 29))))


@check(
    "j7_calendar_all_stations",
    I.with_(I.DAILY)
    + """, years AS (SELECT DISTINCT year(date) AS y FROM daily UNION SELECT 1900 UNION SELECT 2400),
    days AS (SELECT CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM years),
    actual AS (SELECT CAST(date AS DATE) AS date, avg(aqi) AS a FROM daily GROUP BY 1),
    usual AS (SELECT month(date) AS m, day(date) AS d, avg(aqi) AS u FROM daily GROUP BY 1, 2)
    SELECT days.date, CAST(dayofweek(days.date) AS INTEGER) AS day_of_week, CAST(month(days.date) - 1 AS INTEGER) AS month_index,
      CAST(floor(least(greatest(coalesce(a, u, 150.0), 15.0), 500.0)) AS INTEGER) AS aqi,
      CASE WHEN a IS NOT NULL THEN 'actual' WHEN u IS NOT NULL THEN 'climatology' ELSE 'default' END AS origin
    FROM days LEFT JOIN actual ON actual.date = days.date LEFT JOIN usual ON m = month(days.date) AND d = day(days.date)""",
)
def _(spark, sf):
    """The whole table; years without readings reach the climatology, and the default where no year has the day."""
    d = I.daily(spark, sf)
    years = d.select(F.year("date").alias("year")).union(spark.createDataFrame([(1900,), (2400,)], "year int"))
    return spine.year_calendar(d, years.distinct())
