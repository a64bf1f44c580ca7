"""The driver's tables as observation tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

# The prime divisors keep values off rounding ties, so both engines round alike.
DAILY = """
daily AS (
  SELECT o.o_orderpriority AS station, CAST(o.o_orderdate AS DATE) AS date,
    least(CAST(500.0 AS DOUBLE), avg(o.o_totalprice) / CAST(911.0 AS DOUBLE)) AS aqi,
    avg(l.l_quantity) * 4000 / CAST(1013.0 AS DOUBLE) AS pm25,
    avg(l.l_extendedprice) / CAST(211.0 AS DOUBLE) AS pm10,
    avg(l.l_discount) * 1000000 / CAST(1019.0 AS DOUBLE) AS no2,
    avg(l.l_tax) * 50000 / CAST(1021.0 AS DOUBLE) AS co,
    avg(l.l_discount * l.l_quantity) * 10000 / CAST(1031.0 AS DOUBLE) AS o3,
    max(l.l_quantity) * 1000 / CAST(1033.0 AS DOUBLE) AS temperature,
    100 - avg(l.l_quantity) * 1000 / CAST(1039.0 AS DOUBLE) AS humidity,
    min(l.l_quantity) * 200 / CAST(1049.0 AS DOUBLE) AS wind_speed,
    1000 + avg(l.l_tax) * 100000 / CAST(1051.0 AS DOUBLE) AS pressure
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  GROUP BY 1, 2)"""

READINGS = """
readings AS (
  SELECT event_id, event_type AS station, ts AS date,
    value * 1000 / CAST(1009.0 AS DOUBLE) AS aqi,
    CAST(json_extract_string(props, '$.k') AS INTEGER) * 1000 / CAST(1013.0 AS DOUBLE) AS pm25
  FROM events)"""

# Instrument code k below 6 stands for a sensor fault: the reading has no value.
GAPPY = """
gappy AS (
  SELECT event_id, station, date, CASE WHEN pm25 < 6 THEN NULL ELSE aqi END AS aqi,
    CASE WHEN aqi < 12 THEN NULL ELSE pm25 END AS pm25
  FROM readings)"""

# The station's slots at hourly resolution with mean values, gaps kept.
HOURLY = """
slots AS (
  SELECT station, unnest(generate_series(date_trunc('hour', min(date)), date_trunc('hour', max(date)),
    INTERVAL 1 HOUR)) AS date
  FROM gappy GROUP BY station),
hourly AS (
  SELECT s.station, s.date, m.aqi, m.pm25 FROM slots s LEFT JOIN (
    SELECT station, date_trunc('hour', date) AS date, avg(aqi) AS aqi, avg(pm25) AS pm25
    FROM gappy GROUP BY 1, 2) m ON m.station = s.station AND m.date = s.date)"""

# Daily readings on a complete calendar, with null where a station has no reading.
DAYGRID = """
dayslots AS (
  SELECT station, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM daily GROUP BY station),
daygrid AS (
  SELECT s.station, s.date, d.aqi, d.pm25, d.pm10 FROM dayslots s
  LEFT JOIN daily d ON d.station = s.station AND d.date = s.date)"""

TRAIN_END, VAL_END = "1998-12-31", "1999-12-31"
SPLIT = f"""
split AS (
  SELECT *, CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' WHEN date <= DATE '{VAL_END}' THEN 'val'
    ELSE 'test' END AS split FROM daily)"""

LAGGED = """
lagged AS (
  SELECT *, lag(aqi, 1) OVER w AS lag_aqi_1, lag(aqi, 7) OVER w AS lag_aqi_7, row_number() OVER w AS rn
  FROM split WINDOW w AS (PARTITION BY station ORDER BY date))"""

# Two naive forecasts in long form.
PREDICTIONS = """
monthly_train AS (SELECT month(date) AS m, avg(aqi) AS v FROM split WHERE split = 'train' GROUP BY 1),
predictions AS (
  SELECT 'persistence_1' AS model, split, station, date, aqi, lag_aqi_1 AS prediction
  FROM lagged WHERE lag_aqi_1 IS NOT NULL
  UNION ALL
  SELECT 'persistence_7', split, station, date, aqi, lag_aqi_7 FROM lagged WHERE lag_aqi_7 IS NOT NULL
  UNION ALL
  SELECT 'seasonal_mean', split, station, date, aqi, v FROM lagged JOIN monthly_train ON month(date) = m)"""

STATIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CODES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3}
PLACES = {
    "1-URGENT": (28.62, 77.37),
    "2-HIGH": (28.58, 77.31),
    "3-MEDIUM": (28.54, 77.33),
    "4-NOT SPECIFIED": (28.47, 77.49),
    "5-LOW": (28.51, 77.41),
}
COLUMNS = (
    "aqi", "pm25", "pm10", "no2", "co", "o3", "temperature", "humidity", "wind_speed", "pressure",
)


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    joined = o.join(l, o.o_orderkey == l.l_orderkey)
    d = F.lit
    return joined.groupBy(
        F.col("o_orderpriority").alias("station"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(
        F.least(d(500.0), F.avg("o_totalprice") / d(911.0)).alias("aqi"),
        (F.avg("l_quantity") * 4000 / d(1013.0)).alias("pm25"),
        (F.avg("l_extendedprice") / d(211.0)).alias("pm10"),
        (F.avg("l_discount") * 1000000 / d(1019.0)).alias("no2"),
        (F.avg("l_tax") * 50000 / d(1021.0)).alias("co"),
        (F.avg(F.col("l_discount") * F.col("l_quantity")) * 10000 / d(1031.0)).alias("o3"),
        (F.max("l_quantity") * 1000 / d(1033.0)).alias("temperature"),
        (100 - F.avg("l_quantity") * 1000 / d(1039.0)).alias("humidity"),
        (F.min("l_quantity") * 200 / d(1049.0)).alias("wind_speed"),
        (1000 + F.avg("l_tax") * 100000 / d(1051.0)).alias("pressure"),
    )


def stored_daily(spark: SparkSession, sf: str) -> DataFrame:
    """``daily`` computed once, for queries that read it several times: its join is far larger than its rows."""
    return materialise(daily(spark, sf), "daily")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("station"),
        F.col("ts").alias("date"),
        (F.col("value") * 1000 / F.lit(1009.0)).alias("aqi"),
        (F.get_json_object("props", "$.k").cast("int") * 1000 / F.lit(1013.0)).alias("pm25"),
    )


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf)
    return r.withColumns(
        {
            "aqi": F.when(F.col("pm25") >= 6, F.col("aqi")),
            "pm25": F.when(F.col("aqi") >= 12, F.col("pm25")),
        }
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    from breezeframe.operators.grid import resample

    return resample(gappy(spark, sf), ["aqi", "pm25"], "HOUR")


def daygrid(spark: SparkSession, sf: str) -> DataFrame:
    from breezeframe.operators.grid import resample

    return resample(daily(spark, sf), ["aqi", "pm25", "pm10"], "DAY")


def split(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """``rows``, or else the stored daily readings, with their split."""
    from breezeframe.operators.splits import calendar_split

    rows = stored_daily(spark, sf) if rows is None else rows
    return rows.withColumn("split", calendar_split(F.col("date"), TRAIN_END, VAL_END))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    from breezeframe.operators.dedupe import concat_frames
    from breezeframe.operators.history import add_lags
    from breezeframe.operators.scores import persistence, seasonal_mean

    whole = split(spark, sf)
    rows = add_lags(whole, ["aqi"], [1, 7])
    train = whole.where(F.col("split") == "train")
    keep = ["split", "station", "date", "aqi", "prediction"]
    return concat_frames(
        [
            persistence(rows, 1).select(F.lit("persistence_1").alias("model"), *keep),
            persistence(rows, 7).select(F.lit("persistence_7").alias("model"), *keep),
            seasonal_mean(rows, train).select(F.lit("seasonal_mean").alias("model"), *keep),
        ]
    )


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def r(columns: list[str] | tuple[str, ...], places: int = 6, prefix: str = "") -> str:
    """SQL select list that rounds columns under their own names."""
    return ", ".join(f"round({prefix}{c}, {places}) AS {c}" for c in columns)


def timeline():
    """Short segments, so that the small check tables already span several of them."""
    from breezeframe.core.timeline import Timeline

    return Timeline(rows=500)
