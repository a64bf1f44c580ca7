"""Classes, advice, bands, names, weather curves and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.functions import air, weather
from breezeframe.functions.calendar import month_name
from breezeframe.functions.numeric import unscale, zscore
from breezeframe.operators import history, requests

from . import inputs as I
from .registry import check


@check(
    "n8_air_quality_class",
    I.with_(I.DAILY)
    + """SELECT station, date, CAST(CASE WHEN aqi < 0 THEN NULL WHEN aqi <= 50 THEN 0 WHEN aqi <= 100 THEN 1 WHEN aqi <= 200 THEN 2
      WHEN aqi <= 300 THEN 3 WHEN aqi <= 400 THEN 4 WHEN aqi <= 501 THEN 5 END AS INTEGER) AS class,
      CASE WHEN aqi < 0 THEN NULL WHEN aqi <= 50 THEN 'good' WHEN aqi <= 100 THEN 'satisfactory' WHEN aqi <= 200 THEN 'moderate'
      WHEN aqi <= 300 THEN 'poor' WHEN aqi <= 400 THEN 'very_poor' WHEN aqi <= 501 THEN 'severe' END AS label
    FROM (SELECT station, date, aqi * 1.05 - 10 AS aqi FROM daily)""",
)
def _(spark, sf):
    d = I.daily(spark, sf).withColumn("aqi", F.col("aqi") * 1.05 - 10)
    return d.select(
        "station",
        "date",
        air.aqi_class(F.col("aqi")).alias("class"),
        air.aqi_class_name(F.col("aqi")).alias("label"),
    )


def _tiers(limits, labels, x="aqi"):
    whens = " ".join(f"WHEN {x} <= {u} THEN '{t}'" for u, t in zip(limits, labels, strict=False))
    return f"CASE {whens} ELSE '{labels[len(limits)]}' END"


@check(
    "n9_advisory_and_risk",
    I.with_(I.DAILY)
    + f"""SELECT station, date, {_tiers(air.ADVISORY_UPPER, air.ADVISORIES['forecast'])} AS forecast_text,
      {_tiers(air.ADVISORY_UPPER, air.ADVISORIES['lookup'])} AS lookup_text, {_tiers(air.RISK_UPPER, air.RISKS)} AS risk FROM daily""",
)
def _(spark, sf):
    a = F.col("aqi")
    return I.daily(spark, sf).select(
        "station",
        "date",
        air.advisory(a).alias("forecast_text"),
        air.advisory(a, "lookup").alias("lookup_text"),
        air.risk_class(a).alias("risk"),
    )


@check(
    "n10_main_pollutant",
    I.with_(I.DAILY)
    + "SELECT station, date, CASE WHEN pm25 > pm10 * 0.6 THEN 'PM2.5' ELSE 'PM10' END AS main_pollutant FROM daily",
)
def _(spark, sf):
    return I.daily(spark, sf).select(
        "station", "date", air.main_pollutant(F.col("pm25"), F.col("pm10")).alias("main_pollutant")
    )


@check(
    "n11_forecast_bands",
    I.with_(I.DAILY)
    + """SELECT station, date, h AS hours, round(greatest(0.0, aqi - (9.2 + 0.35 * h)), 6) AS lower, round(aqi + (9.2 + 0.35 * h), 6) AS upper,
      round(greatest(0.0, aqi - round(8 + 0.25 * h)), 6) AS screen_lower, round(aqi + round(8 + 0.25 * h), 6) AS screen_upper,
      round(greatest(75.0::DOUBLE, 98.0::DOUBLE - 0.28::DOUBLE * h), 6) AS confidence,
      CASE WHEN h < 24 THEN '+' || h || ' hours' ELSE '+' || (h // 24) || ' days' END AS horizon
    FROM daily, (SELECT unnest([1, 3, 6, 12, 24, 48, 72])::INTEGER AS h)""",
)
def _(spark, sf):
    d = I.daily(spark, sf).withColumn("hours", F.explode(F.array(*[F.lit(h) for h in air.HORIZONS])))
    h = F.col("hours")
    lo, hi = air.band(F.col("aqi"), h)
    slo, shi = air.band(F.col("aqi"), h, "screen")
    return d.select(
        "station",
        "date",
        "hours",
        F.round(lo, 6).alias("lower"),
        F.round(hi, 6).alias("upper"),
        F.round(slo, 6).alias("screen_lower"),
        F.round(shi, 6).alias("screen_upper"),
        F.round(air.confidence(h), 6).alias("confidence"),
        air.horizon_label(h).alias("horizon"),
    )


@check(
    "n13_diurnal_weather",
    I.with_(I.READINGS)
    + """, w AS (SELECT event_id, hour(date) AS h, aqi / 10 AS t, pm25 AS u, aqi / 50 AS v, 1000 + pm25 / 10 AS p FROM readings)
    SELECT event_id, round(t + 5 * sin(2 * pi() * (h - 8) / 24), 6) AS temperature,
      round(least(greatest(u - 15 * sin(2 * pi() * (h - 8) / 24), 10.0), 100.0), 6) AS humidity,
      round(greatest(v + 2 * cos(2 * pi() * (h - 12) / 24), 1.0), 6) AS wind_speed,
      round(p + 2 * sin(2 * pi() * h / 24), 6) AS pressure FROM w""",
)
def _(spark, sf):
    r = I.readings(spark, sf)
    curve = weather.diurnal(
        F.hour("date"), F.col("aqi") / 10, F.col("pm25"), F.col("aqi") / 50, 1000 + F.col("pm25") / 10
    )
    return r.select("event_id", *[F.round(c, 6).alias(n) for n, c in curve.items()])


@check(
    "n14_zscore_and_inverse",
    I.with_(I.DAILY)
    + """, s AS (SELECT avg(aqi) AS m, stddev_pop(aqi) AS sd FROM daily)
    SELECT station, date, round((aqi - m) / sd, 6) AS z, round(aqi, 6) AS aqi FROM daily, s""",
)
def _(spark, sf):
    d = I.daily(spark, sf)
    s = d.agg(F.struct(F.avg("aqi").alias("m"), F.stddev_pop("aqi").alias("sd")).alias("s")).scalar()
    z = d.withColumn("_s", s).withColumn("z", zscore(F.col("aqi"), F.col("_s.m"), F.col("_s.sd")))
    back = z.withColumn("aqi", unscale(F.col("z"), F.col("_s.m"), F.col("_s.sd")))
    return I.rounded(back.select("station", "date", "z", "aqi"), ["z", "aqi"])


@check(
    "n15_display_names",
    """SELECT p_partkey, list_aggregate(list_transform(string_split(replace(lower(p_name), '_', ' '), ' '),
        lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS title,
      ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][1 + p_partkey % 12] AS month FROM part""",
)
def _(spark, sf):
    p = I.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        air.display_name(F.col("p_name")).alias("title"),
        month_name((1 + F.col("p_partkey") % 12).cast("int")).alias("month"),
    )


_SCALED = ["aqi", "pm25", "pm10", "temperature"]


@check(
    "a40_scaler",
    I.with_(I.DAILY, I.SPLIT)
    + ", s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)
    + " FROM split WHERE split = 'train') SELECT station, date, 0.0::DOUBLE AS constant, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED)
    + " FROM split, s",
)
def _(spark, sf):
    s = I.split(spark, sf).withColumn("constant", F.lit(7.0))
    cols = [*_SCALED, "constant"]
    fitted = history.scaler(s.where("split = 'train'"), cols)
    return I.rounded(history.scale(s, fitted, cols).select("station", "date", *cols), cols)


@check(
    "a40_scaler_inverse",
    I.with_(I.DAILY) + f"SELECT station, date, {I.r(_SCALED)} FROM daily",
)
def _(spark, sf):
    s = I.split(spark, sf)
    fitted = history.scaler(s.where("split = 'train'"), _SCALED)
    back = history.unscale(history.scale(s, fitted, _SCALED), fitted, _SCALED)
    return I.rounded(back.select("station", "date", *_SCALED), _SCALED)


# Requests made from the daily readings: text fields, some missing, malformed or out of bounds.
_REQUESTS = """
requests AS (
  SELECT station || ' ' || CAST(date AS VARCHAR) AS request, CASE WHEN aqi >= 500 THEN 'elsewhere' ELSE station END AS station,
    CASE WHEN co > 2.5 THEN 'Prophet' ELSE 'DecisionTree' END AS model,
    CASE WHEN month(date) = 2 THEN strftime(date, '%Y/%m/%d') ELSE strftime(date, '%Y-%m-%d') END AS date,
    CASE WHEN day(date) = 31 THEN '7:30' WHEN day(date) = 30 THEN '24:10' ELSE '07:30' END AS time,
    CASE WHEN pm25 < 40 THEN NULL ELSE CAST(CAST(floor(pm25 * 9) AS BIGINT) AS VARCHAR) END AS pm25,
    CASE WHEN pm10 > 350 THEN 'n/a' ELSE CAST(CAST(floor(pm10 * 3) AS BIGINT) AS VARCHAR) END AS pm10,
    CAST(CAST(floor(no2) AS BIGINT) AS VARCHAR) AS no2, CAST(CAST(floor(temperature * 1.4) AS BIGINT) AS VARCHAR) AS temperature,
    CAST(CAST(floor(humidity * 1.2) AS BIGINT) AS VARCHAR) AS humidity, CAST(CAST(floor(wind_speed - 1) AS BIGINT) AS VARCHAR) AS wind_speed
  FROM daily)"""


def request_table(spark, sf):
    d = I.daily(spark, sf)

    def text(c):
        return F.floor(c).cast("string")

    return d.select(
        F.concat_ws(" ", "station", F.col("date").cast("string")).alias("request"),
        F.when(F.col("aqi") >= 500, "elsewhere").otherwise(F.col("station")).alias("station"),
        F.when(F.col("co") > 2.5, "Prophet").otherwise("DecisionTree").alias("model"),
        F.when(F.month("date") == 2, F.date_format("date", "yyyy/MM/dd"))
        .otherwise(F.date_format("date", "yyyy-MM-dd"))
        .alias("date"),
        F.when(F.dayofmonth("date") == 31, "7:30")
        .when(F.dayofmonth("date") == 30, "24:10")
        .otherwise("07:30")
        .alias("time"),
        F.when(F.col("pm25") >= 40, text(F.col("pm25") * 9)).alias("pm25"),
        F.when(F.col("pm10") > 350, "n/a").otherwise(text(F.col("pm10") * 3)).alias("pm10"),
        text(F.col("no2")).alias("no2"),
        text(F.col("temperature") * 1.4).alias("temperature"),
        text(F.col("humidity") * 1.2).alias("humidity"),
        text(F.col("wind_speed") - 1).alias("wind_speed"),
    )


def _field_tests():
    tests = []
    for c, (lo, hi) in requests.REQUEST_LIMITS.items():
        tests += [
            f"CASE WHEN {c} IS NULL THEN 'missing {c}' END",
            f"CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL THEN 'not a number: {c}' END",
            f"CASE WHEN TRY_CAST({c} AS DOUBLE) NOT BETWEEN {lo} AND {hi} THEN 'out of bounds: {c}' END",
        ]
    return ", ".join(tests)


@check(
    "p13_request_validation",
    I.with_(I.DAILY, _REQUESTS)
    + f""", tested AS (SELECT request, concat_ws(', ', {_field_tests()},
      CASE WHEN station = 'elsewhere' THEN 'unknown station' END, CASE WHEN model = 'Prophet' THEN 'unknown model' END,
      CASE WHEN length(date) <> 10 OR try_strptime(date, '%Y-%m-%d') IS NULL THEN 'bad date' END,
      CASE WHEN time <> '07:30' THEN 'bad time' END) AS reasons FROM requests)
    SELECT request, reasons, CAST(reasons = '' AS INTEGER) AS valid FROM tested""",
)
def _(spark, sf):
    checked = requests.check_requests(request_table(spark, sf), I.STATIONS)
    return checked.select("request", F.concat_ws(", ", "reasons").alias("reasons"), "valid")


_WHAT_IF = ["pm25", "pm10", "no2", "temperature", "humidity"]


@check(
    "p21_what_if_rows",
    I.with_(I.DAILY, I.SPLIT)
    + ", m AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}" for c in [*_WHAT_IF, "pressure"])
    + """ FROM split WHERE split = 'train'), s AS (
      SELECT station, date, month(date) AS month, CASE WHEN aqi > 300 THEN pm25 * 2 END AS pm25, CASE WHEN aqi < 100 THEN pm10 / 2 END AS pm10,
        temperature FROM daily)
    SELECT station, date, round(coalesce(pm25, m_pm25), 6) AS pm25, round(coalesce(pm10, m_pm10), 6) AS pm10, round(m_no2, 6) AS no2,
      round(coalesce(temperature, m_temperature), 6) AS temperature, round(m_humidity, 6) AS humidity, round(m_pressure, 6) AS pressure,
      round(sin(2 * pi() * month / 12), 6) + 0.0 AS sin_month, round(cos(2 * pi() * (month * 30) / 365.25), 6) + 0.0 AS cos_day_of_year,
      CAST(month IN (10, 11) AS INTEGER) AS is_stubble_burning, CAST(month IN (11, 12, 1, 2) AS INTEGER) AS "season_Winter" FROM s, m""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    scenarios = I.daily(spark, sf).select(
        "station",
        "date",
        F.month("date").alias("month"),
        F.when(F.col("aqi") > 300, F.col("pm25") * 2).alias("pm25"),
        F.when(F.col("aqi") < 100, F.col("pm10") / 2).alias("pm10"),
        "temperature",
    )
    names = [*_WHAT_IF, "pressure"]
    rows = requests.what_if(scenarios, s.where("split = 'train'"), names)
    cols = [*names, "sin_month", "cos_day_of_year"]
    out = rows.select("station", "date", *cols, "is_stubble_burning", "season_Winter")
    return I.rounded(out, cols).withColumns({c: F.col(c) + F.lit(0.0) for c in ("sin_month", "cos_day_of_year")})


_MOVED = ["pm25", "pm10", "no2", "co", "o3", "temperature", "humidity", "wind_speed"]


@check(
    "p22_sensitivity_deltas",
    I.with_(I.DAILY)
    + """, base AS (SELECT station, avg(pm25) AS pm25, avg(pm10) AS pm10, avg(temperature) AS temperature, avg(humidity) AS humidity,
      avg(wind_speed) AS wind_speed, avg(co) AS co FROM daily GROUP BY 1),
    deltas AS (SELECT station, pm25 * 0.2 - pm25 AS d_pm25, pm10 * 1.5 - pm10 AS d_pm10, temperature + 3 - temperature AS d_temperature,
      humidity * 1.3 - humidity AS d_humidity, wind_speed - 4 - wind_speed AS d_wind_speed, co * 0.1 - co AS d_co FROM base)
    SELECT d.station, d.date, round(greatest(pm25 + d_pm25, 1.0), 6) AS pm25, round(greatest(pm10 + d_pm10, 1.0), 6) AS pm10,
      round(greatest(no2, 0.1), 6) AS no2, round(greatest(co + d_co, 0.01), 6) AS co, round(greatest(o3, 0.1), 6) AS o3,
      round(temperature + d_temperature, 6) AS temperature, round(least(greatest(humidity + d_humidity, 0.0), 100.0), 6) AS humidity,
      round(greatest(wind_speed + d_wind_speed, 0.0), 6) AS wind_speed FROM daily d JOIN deltas USING (station)""",
)
def _(spark, sf):
    d = I.daily(spark, sf).withColumn("so2", F.lit(None).cast("double"))
    names = list(requests.DELTA_COLUMNS)
    base = d.groupBy("station").agg(*[F.avg(c).alias(c) for c in names])
    asked = base.select(
        "station",
        (F.col("pm25") * 0.2).alias("pm25"),
        (F.col("pm10") * 1.5).alias("pm10"),
        (F.col("temperature") + 3).alias("temperature"),
        (F.col("humidity") * 1.3).alias("humidity"),
        (F.col("wind_speed") - 4).alias("wind_speed"),
        (F.col("co") * 0.1).alias("co"),
    )
    deltas = requests.override_deltas(asked, base, "station")
    moved = requests.apply_deltas(d, deltas, "station")
    return I.rounded(moved.select("station", "date", *_MOVED), _MOVED)
