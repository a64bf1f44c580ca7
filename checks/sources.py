"""Readers and writers, exercised as round trips through the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.core import schema as S
from breezeframe.operators import explore, report_text, schema_ops
from breezeframe.plans import training
from breezeframe.sources import readers, writers
from breezeframe.core.shared import scratch

from . import inputs as I
from .registry import check

_CORE = ["aqi", "pm25", "pm10"]


@check(
    "s1_station_csv_scan",
    I.with_(I.DAILY) + f"SELECT station, CAST(date AS TIMESTAMP) AS date, {I.r(_CORE)} FROM daily",
)
def _(spark, sf):
    folder = scratch(spark, "stations")
    raw = I.daily(spark, sf).select(
        F.date_format("date", "dd-MM-yyyy").alias("Date"),
        F.concat(F.lit(" "), "station").alias("StationName"),
        F.col("aqi").alias("AQI"),
        F.col("pm25").alias("PM2.5"),
        F.col("pm10").alias("PM10"),
    )
    # The same rows again in files with another column order: duplicates, which must vanish.
    raw.write.option("header", True).csv(folder)
    raw.select("StationName", "Date", "AQI", "`PM2.5`", "PM10").write.mode("append").option(
        "header", True
    ).csv(folder)
    found = schema_ops.coerce(readers.scan_station_files(spark, folder, "unused", "part-*.csv"))
    return I.rounded(found.select("station", "date", *_CORE), _CORE)


@check(
    "s2_csv_dialects",
    I.with_(I.DAILY)
    + """SELECT CASE WHEN aqi < 250 THEN 'Québec ' || station ELSE station END AS station, CAST(date AS TIMESTAMP) AS date, round(aqi, 6) AS aqi
    FROM daily""",
)
def _(spark, sf):
    folder = scratch(spark, "dialects")
    d = I.daily(spark, sf)
    old = d.where("aqi < 250").select(
        F.date_format("date", "yyyy-MM-dd").alias("datetime"),
        F.concat(F.lit("Québec "), "station").alias("Station"),
        F.col("aqi").alias("AQI"),
    )
    new = d.where("aqi >= 250").select(
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "station", "aqi"
    )
    old.write.options(header=True, sep=";", encoding="ISO-8859-1").csv(folder)
    new.write.mode("append").options(header=True).csv(folder)
    found = schema_ops.coerce(readers.scan_station_files(spark, folder, "none"))
    return I.rounded(found.select("station", "date", "aqi"), ["aqi"])


@check(
    "s3_external_table",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS name FROM orders",
)
def _(spark, sf):
    path = scratch(spark, "holidays")
    o = I.table(spark, sf, "orders")
    o.select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("name")).distinct().write.option(
        "header", True
    ).csv(path)
    return readers.load_external(spark, path, "date date, name string")


@check(
    "s4_typed_table_read",
    I.with_(I.DAILY) + f"SELECT station, CAST(date AS TIMESTAMP) AS date, {I.r(_CORE)} FROM daily",
)
def _(spark, sf):
    path = scratch(spark, "table")
    I.daily(spark, sf).select("station", F.col("date").cast("string").alias("date"), *_CORE).write.option(
        "header", True
    ).csv(path)
    ddl = "station string, date string, aqi double, pm25 double, pm10 double"
    return I.rounded(readers.load_table(spark, path, ddl, "csv", dates=["date"]), _CORE)


@check(
    "s5_frame_as_source",
    """SELECT 'north' AS station, date_trunc('minute', ts) AS date, CASE WHEN value < 5 THEN NULL ELSE round(value, 6) END AS aqi
    FROM events WHERE event_type <> 'view'""",
)
def _(spark, sf):
    e = I.table(spark, sf, "events")
    raw = e.select(
        F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm")).alias("date_time"),
        F.when(F.col("value") < 5, "low").otherwise(F.col("value").cast("string")).alias("aqi_value"),
    )
    return I.rounded(schema_ops.as_observations(raw, "north"), ["aqi"])


# Report lines: one layout per source, with month names, sparse and summary lines, and free text.
_HUNDREDTHS = [
    "aqi", "pm25", "pm10", "no2", "temperature", "co", "o3", "humidity", "wind_speed", "pressure",
]
_LINES = f"""
h AS (SELECT station, date, {', '.join(f"CAST(CAST(floor({c} * 100) AS BIGINT) AS VARCHAR) AS {c}" for c in _HUNDREDTHS)} FROM daily),
lines AS (
  SELECT 'annual' AS source, concat_ws('  ', CAST(date AS VARCHAR), strftime(date, '%B'), aqi, pm25, pm10, no2, temperature, co, o3, humidity,
    wind_speed) AS line FROM h WHERE station = '1-URGENT'
  UNION ALL SELECT 'meteo', ' ' || concat_ws(' ', CAST(date AS VARCHAR), aqi, 'Poor', pm25, pm10, no2, humidity, temperature, co, o3, wind_speed,
    temperature, humidity, wind_speed, pressure) FROM h WHERE station = '2-HIGH'
  UNION ALL SELECT 'short', concat_ws(' ', CAST(date AS VARCHAR), lower(strftime(date, '%B')), aqi, pm25, pm10, no2, 'n/a') FROM h
    WHERE station NOT IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT 'short', concat_ws(' ', CAST(date AS VARCHAR), aqi) FROM h WHERE station = '1-URGENT'
  UNION ALL SELECT 'annual', concat_ws(' ', 'Average', aqi, pm25, pm10, no2) FROM h WHERE station = '2-HIGH'
  UNION ALL SELECT 'text', unnest(string_split(text, chr(10))) FROM documents),
parts AS (SELECT source, regexp_split_to_array(trim(line, ' \t'), '\\s+') AS p FROM lines WHERE regexp_matches(trim(line, ' \t'), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')),
cells AS (SELECT source, CASE WHEN len(p) > 1 AND lower(p[2]) IN ({', '.join(f"'{m}'" for m in report_text.MONTHS)})
  THEN list_concat(p[1:1], p[3:]) ELSE p END AS c FROM parts),
rows AS (SELECT source, c FROM cells WHERE regexp_full_match(c[1], '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND len(c) >= 4)"""
_BASE = I.with_(I.DAILY, _LINES)


def report_lines(spark, sf):
    d = I.stored_daily(spark, sf)
    h = d.select("station", "date", *[F.floor(F.col(c) * 100).cast("string").alias(c) for c in _HUNDREDTHS])
    day, month = F.col("date").cast("string"), F.date_format("date", "MMMM")
    first, second = F.col("station") == "1-URGENT", F.col("station") == "2-HIGH"
    annual = h.where(first).select(
        F.lit("annual").alias("source"),
        F.concat_ws("  ", day, month, "aqi", "pm25", "pm10", "no2", "temperature", "co", "o3", "humidity", "wind_speed").alias("value"),
    )
    meteo = h.where(second).select(
        F.lit("meteo").alias("source"),
        F.concat(
            F.lit(" "),
            F.concat_ws(
                " ", day, "aqi", F.lit("Poor"), "pm25", "pm10", "no2", "humidity", "temperature", "co", "o3",
                "wind_speed", "temperature", "humidity", "wind_speed", "pressure",
            ),
        ).alias("value"),
    )
    short = h.where(~first & ~second).select(
        F.lit("short").alias("source"),
        F.concat_ws(" ", day, F.lower(month), "aqi", "pm25", "pm10", "no2", F.lit("n/a")).alias("value"),
    )
    sparse = h.where(first).select(F.lit("short").alias("source"), F.concat_ws(" ", day, "aqi").alias("value"))
    average = h.where(second).select(
        F.lit("annual").alias("source"), F.concat_ws(" ", F.lit("Average"), "aqi", "pm25", "pm10", "no2").alias("value")
    )
    text = I.table(spark, sf, "documents").select(
        F.lit("text").alias("source"), F.explode(F.split("text", "\n")).alias("value")
    )
    return annual.union(meteo).union(short).union(sparse).union(average).union(text)


@check(
    "s6_report_text_scan",
    _BASE + "SELECT source, array_to_string(c, '|') AS cells FROM cells",
)
def _(spark, sf):
    path = scratch(spark, "reports")
    report_lines(spark, sf).write.partitionBy("source").text(path)
    found = readers.scan_report_text(spark, path)
    return found.select("source", F.concat_ws("|", "cells").alias("cells"))


@check(
    "p3_layout_mapping",
    _BASE
    + """SELECT 'annual' AS layout, c[1] AS date, c[2] AS aqi, c[3] AS pm25, c[6] AS so2, c[7] AS co, c[9] AS nh3, CAST(NULL AS VARCHAR) AS wind_direction
    FROM rows WHERE source = 'annual'
    UNION ALL SELECT 'meteo', c[1], c[2], c[4], c[8], c[9], c[7], c[15] FROM rows WHERE source = 'meteo'
    UNION ALL SELECT 'short', c[1], c[2], c[3], c[6], c[7], c[9], NULL FROM rows WHERE source NOT IN ('annual', 'meteo')""",
)
def _(spark, sf):
    found = report_text.recover_rows(report_lines(spark, sf))
    layout = F.when(F.col("source").isin("annual", "meteo"), F.col("source")).otherwise("short")
    return found.select(layout.alias("layout"), "date", "aqi", "pm25", "so2", "co", "nh3", "wind_direction")


@check(
    "p4_layout_detection",
    _BASE
    + """, w AS (SELECT source, len(c) AS width, count(*) AS n FROM rows GROUP BY 1, 2),
    m AS (SELECT source, width, row_number() OVER (PARTITION BY source ORDER BY n DESC, width) AS rn FROM w)
    SELECT source, CAST(width AS INTEGER) AS modal_width, CASE WHEN width >= 14 THEN 'meteo' WHEN width >= 10 THEN 'annual' ELSE 'short' END AS layout
    FROM m WHERE rn = 1""",
)
def _(spark, sf):
    rows = report_text.parse_lines(report_lines(spark, sf)).where(report_text.is_data_row(F.col("cells")))
    return report_text.detect_layouts(rows)


@check(
    "p5_fixed_width_rows",
    _BASE
    + """SELECT source, 10 AS width, c[1] AS first, c[10] AS last, CAST(list_count(c[1:10]) AS INTEGER) AS filled FROM cells""",
)
def _(spark, sf):
    rows = report_text.parse_lines(report_lines(spark, sf))
    fitted = rows.withColumn("cells", report_text.fit_width(F.col("cells"), S.LAYOUT_WIDTHS["short"]))
    known = F.size(F.filter("cells", lambda c: c.isNotNull()))
    return fitted.select(
        "source",
        F.size("cells").alias("width"),
        F.get("cells", F.lit(0)).alias("first"),
        F.get("cells", F.lit(9)).alias("last"),
        known.alias("filled"),
    )


@check(
    "p6_data_row_filter",
    _BASE + "SELECT source, c[1] AS date, CAST(len(c) AS INTEGER) AS width FROM rows",
)
def _(spark, sf):
    rows = report_text.parse_lines(report_lines(spark, sf)).where(report_text.is_data_row(F.col("cells")))
    return rows.select("source", F.get("cells", F.lit(0)).alias("date"), F.size("cells").alias("width"))


@check("s7_station_sink", I.with_(I.DAILY) + f"SELECT station, date, {I.r(_CORE)} FROM daily")
def _(spark, sf):
    path = scratch(spark, "by-station")
    writers.write_by_station(I.daily(spark, sf).select("station", "date", *_CORE), path)
    return I.rounded(readers.load_table(spark, path), _CORE)


@check(
    "s8_split_sink",
    I.with_(I.DAILY, I.SPLIT) + "SELECT station, date, round(aqi, 6) AS aqi, split FROM split WHERE split IN ('val', 'test')",
)
def _(spark, sf):
    path = scratch(spark, "by-split")
    writers.write_splits(I.split(spark, sf).select("station", "date", "aqi", "split"), path)
    # Only the two folders that the filter names are opened.
    return I.rounded(readers.load_table(spark, path).where(F.col("split").isin("val", "test")), ["aqi"])


@check(
    "s9_report_sink",
    I.with_(I.DAILY)
    + """, f AS (SELECT count(*)::DOUBLE AS rows, avg(aqi) AS aqi_mean, max(aqi) AS aqi_max FROM daily)
    SELECT metric, round(value, 6) AS value FROM (UNPIVOT f ON COLUMNS(*) INTO NAME metric VALUE value)""",
)
def _(spark, sf):
    path = scratch(spark, "report")
    facts = explore.summary_facts(I.daily(spark, sf), [])
    writers.write_report(facts, path)
    back = spark.read.schema("metric string, value double").json(path)
    return I.rounded(back.where(F.col("metric").isin("rows", "aqi_mean", "aqi_max")), ["value"])


@check(
    "s10_append_log_view",
    "SELECT event_id, ts, event_type, round(value, 6) AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def _(spark, sf):
    path = scratch(spark, "log")
    e = I.table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    writers.append_log(e.where("value < 20"), path)
    writers.append_log(e.where("value >= 20"), path)
    return I.rounded(writers.read_log(spark, path, ["ts", "event_id"]), ["value"])


@check(
    "s11_export_selection",
    I.with_(I.DAILY)
    + "SELECT station, date, round(aqi, 6) AS aqi FROM daily WHERE year(date) = 1997 AND station = '3-MEDIUM'",
)
def _(spark, sf):
    path = scratch(spark, "export")
    picked = explore.select_years(I.daily(spark, sf), 1997, 1997, ["3-MEDIUM"])
    writers.export_selection(picked.select("station", "date", "aqi"), path)
    back = readers.load_table(spark, path, "station string, date date, aqi double", "csv")
    return I.rounded(back, ["aqi"])


@check(
    "s12_model_save_and_load",
    I.with_(I.DAILY, I.SPLIT)
    + """, m AS (SELECT regr_slope(aqi, pm25) AS a, regr_intercept(aqi, pm25) AS b FROM split WHERE split = 'train')
    SELECT station, date, round(a * pm25 + b, 5) AS prediction FROM split, m""",
)
def _(spark, sf):
    s = I.split(spark, sf)
    path = scratch(spark, "model")
    writers.save_model(training.linear_model(s.where("split = 'train'"), ["pm25"]), path)
    scored = writers.load_model(path).transform(s)
    return I.rounded(scored.select("station", "date", "prediction"), ["prediction"], 5)
