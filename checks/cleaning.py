"""Schema work, duplicates, grids and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.operators import dedupe, fill, grid, schema_ops

from . import inputs as I
from .registry import check


@check(
    "p1_trim_text",
    "SELECT c_custkey AS id, trim(c_mktsegment) AS segment, trim(c_name) AS name FROM customer",
)
def _(spark, sf):
    c = I.table(spark, sf, "customer")
    messy = c.select(
        F.col("c_custkey").alias(" id "),
        F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("segment "),
        F.concat("c_name", F.lit("   ")).alias("  name"),
    )
    return schema_ops.trim_all(messy)


@check(
    "p2_alias_rename",
    I.with_(I.READINGS) + "SELECT date, station, round(aqi, 6) AS aqi, round(pm25, 6) AS pm25 FROM readings",
)
def _(spark, sf):
    raw = I.readings(spark, sf).select(
        F.col("date").alias("Timestamp"),
        F.col("station").alias("StationName"),
        F.round("aqi", 6).alias("air_quality_index"),
        F.round("pm25", 6).alias("PM2.5"),
    )
    return schema_ops.rename_aliases(raw)


_TEXT = """
raw AS (
  SELECT CASE WHEN k < 6 THEN 'N/A' WHEN k < 10 THEN '--' WHEN k < 12 THEN NULL ELSE CAST(k AS VARCHAR) END AS pm25,
    CASE WHEN k > 95 THEN '' ELSE ' ' || CAST(k AS VARCHAR) || ' ' END AS pm10
  FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


@check(
    "p7_numeric_coercion",
    I.with_(_TEXT)
    + """SELECT 'pm25' AS variable, count(*) FILTER (pm25 IS NOT NULL AND TRY_CAST(pm25 AS DOUBLE) IS NULL) AS newly_null FROM raw
    UNION ALL
    SELECT 'pm10', count(*) FILTER (pm10 IS NOT NULL AND TRY_CAST(trim(pm10) AS DOUBLE) IS NULL) FROM raw""",
)
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = I.table(spark, sf, "events").select(
        F.when(k < 6, "N/A").when(k < 10, "--").when(k < 12, None).otherwise(k.cast("string")).alias("pm25"),
        F.when(k > 95, "").otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).alias("pm10"),
    )
    return schema_ops.coercion_losses(raw, ["pm25", "pm10"])


@check(
    "p8_mixed_timestamp_formats",
    """SELECT event_id, CASE event_type WHEN 'error' THEN date_trunc('minute', ts)
      WHEN 'view' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS date FROM events""",
)
def _(spark, sf):
    t, kind = F.col("ts"), F.col("event_type")
    text = (
        F.when(kind == "error", F.date_format(t, "dd-MM-yyyy HH:mm"))
        .when(kind == "view", F.date_format(t, "dd-MM-yyyy"))
        .when(kind == "purchase", F.date_format(t, "dd/MM/yyyy HH:mm:ss"))
        .when(kind == "signup", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    )
    return I.table(spark, sf, "events").select("event_id", schema_ops.parse_timestamp(text).alias("date"))


@check(
    "p9_schema_validation",
    I.with_(I.READINGS)
    + """SELECT date, station, round(aqi, 6) AS aqi, round(pm25, 6) AS pm25, CAST(NULL AS DOUBLE) AS pm10,
      CAST(NULL AS DOUBLE) AS no2, CAST(NULL AS DOUBLE) AS pressure FROM readings""",
)
def _(spark, sf):
    raw = I.readings(spark, sf).select(
        F.col("date").cast("string").alias("datetime"),
        F.col("station").alias("Station"),
        F.col("aqi").alias("AQI"),
        F.col("pm25").alias("PM25"),
    )
    # Text timestamps with fractions are outside the format list, so the typed column is put back.
    typed = raw.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    ok = schema_ops.validate(typed)
    return ok.select(
        "date", "station", F.round("aqi", 6).alias("aqi"), F.round("pm25", 6).alias("pm25"), "pm10", "no2", "pressure"
    )


_WIDE = "wide AS (SELECT pm10 * 5 AS pm10, humidity * 1.3 AS humidity, co * 20 AS co, temperature * 1.2 AS temperature FROM daily)"
_RANGES = {"pm10": (0, 1500), "humidity": (0, 100), "co": (0, 50), "temperature": (-5, 55)}


@check(
    "p10_range_violations",
    I.with_(I.DAILY, _WIDE)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS violations, "
        f"round(count(*) FILTER ({c} < {lo} OR {c} > {hi}) * 100.0 / CAST(count({c}) AS DOUBLE), 6) AS pct FROM wide"
        for c, (lo, hi) in _RANGES.items()
    ),
)
def _(spark, sf):
    wide = I.daily(spark, sf).select(
        (F.col("pm10") * 5).alias("pm10"),
        (F.col("humidity") * 1.3).alias("humidity"),
        (F.col("co") * 20).alias("co"),
        (F.col("temperature") * 1.2).alias("temperature"),
    )
    return I.rounded(schema_ops.range_violations(wide), ["pct"])


@check(
    "p11_station_column",
    "SELECT event_id, event_type AS station, 'north' AS fallback FROM events",
)
def _(spark, sf):
    e = I.table(spark, sf, "events")
    padded = e.select("event_id", F.concat(F.lit(" "), "event_type", F.lit("  ")).alias("station"))
    kept = schema_ops.attach_station(padded, "unused")
    added = schema_ops.attach_station(kept.withColumnRenamed("station", "_s"), "north")
    return added.select("event_id", F.col("_s").alias("station"), F.col("station").alias("fallback"))


@check(
    "p15_non_negative_clip",
    I.with_(I.DAILY)
    + """SELECT station, date, round(greatest(aqi - 60, 0.0), 6) AS aqi, round(greatest(no2 - 40, 0.0), 6) AS no2,
      round(temperature - 60, 6) AS temperature FROM daily""",
)
def _(spark, sf):
    d = I.daily(spark, sf).select(
        "station",
        "date",
        (F.col("aqi") - 60).alias("aqi"),
        (F.col("no2") - 40).alias("no2"),
        (F.col("temperature") - 60).alias("temperature"),
    )
    return I.rounded(schema_ops.clip_non_negative(d), ["aqi", "no2", "temperature"])


@check(
    "p16_low_coverage_columns",
    I.with_(I.READINGS, I.GAPPY)
    + """SELECT station, date, aqi FROM (SELECT station, date, round(aqi, 6) AS aqi FROM gappy)""",
)
def _(spark, sf):
    g = I.gappy(spark, sf).select("station", "date", "aqi", "pm25")
    low = schema_ops.low_coverage_columns(g, ["aqi", "pm25"], 0.9)
    return I.rounded(g.drop(*low), ["aqi"])


@check(
    "p16_column_coverage",
    I.with_(I.READINGS, I.GAPPY)
    + """SELECT 'aqi' AS variable, round(avg(CASE WHEN aqi IS NULL THEN 0.0 ELSE 1.0 END), 6) AS valid_share FROM gappy
    UNION ALL SELECT 'pm25', round(avg(CASE WHEN pm25 IS NULL THEN 0.0 ELSE 1.0 END), 6) FROM gappy""",
)
def _(spark, sf):
    return I.rounded(schema_ops.coverage(I.gappy(spark, sf), ["aqi", "pm25"]), ["valid_share"])


@check(
    "p17_drop_incomplete_rows",
    I.with_(I.READINGS, I.GAPPY)
    + "SELECT event_id, station, date FROM gappy WHERE aqi IS NOT NULL AND pm25 IS NOT NULL",
)
def _(spark, sf):
    return schema_ops.drop_incomplete(I.gappy(spark, sf)).select("event_id", "station", "date")


@check(
    "w13_keep_first_per_key",
    I.with_(I.READINGS)
    + """SELECT station, date, round(aqi, 6) AS aqi, priority FROM (
      SELECT *, row_number() OVER (PARTITION BY station, date ORDER BY priority) AS rn FROM (
        SELECT station, date, aqi, 2 AS priority FROM readings
        UNION ALL SELECT station, date, aqi + 1000, 1 FROM readings WHERE pm25 > 50
        UNION ALL SELECT station, date, aqi + 2000, 3 FROM readings)) WHERE rn = 1""",
)
def _(spark, sf):
    base = I.readings(spark, sf)
    keep = ["station", "date", "aqi", "priority"]
    mixed = dedupe.concat_frames(
        [
            base.withColumn("priority", F.lit(2)).select(keep),
            base.where("pm25 > 50").withColumn("aqi", F.col("aqi") + 1000).withColumn("priority", F.lit(1)).select(keep),
            base.withColumn("aqi", F.col("aqi") + 2000).withColumn("priority", F.lit(3)).select(keep),
        ]
    )
    return I.rounded(dedupe.keep_first(mixed, ["priority"]), ["aqi"])


@check(
    "w19_source_priority_merge",
    I.with_(I.DAILY)
    + """SELECT station, date, round(CASE WHEN aqi > 250 THEN aqi ELSE aqi / 2 END, 6) AS aqi,
      round(CASE WHEN aqi > 250 THEN pm25 END, 6) AS pm25 FROM daily""",
)
def _(spark, sf):
    d = I.daily(spark, sf)
    first = d.where("aqi > 250").select("station", "date", "aqi", "pm25")
    second = d.select("station", "date", (F.col("aqi") / 2).alias("aqi"))
    return I.rounded(dedupe.merge_sources([first, second]), ["aqi", "pm25"])


@check(
    "u1_concat_different_columns",
    I.with_(I.READINGS)
    + """SELECT station, date, round(aqi, 6) AS aqi, CAST(NULL AS DOUBLE) AS pm25 FROM readings
    UNION ALL SELECT station, date, NULL, round(pm25, 6) FROM readings""",
)
def _(spark, sf):
    base = I.rounded(I.readings(spark, sf), ["aqi", "pm25"])
    return dedupe.concat_frames([base.select("station", "date", "aqi"), base.select("station", "date", "pm25")])


@check(
    "a1_hourly_grid",
    I.with_(I.READINGS, I.GAPPY, I.HOURLY) + f"SELECT station, date, {I.r(['aqi', 'pm25'])} FROM hourly",
)
def _(spark, sf):
    return I.rounded(I.hourly(spark, sf), ["aqi", "pm25"])


@check(
    "a1_daily_grid",
    I.with_(I.DAILY, I.DAYGRID) + f"SELECT station, date, {I.r(['aqi', 'pm25', 'pm10'])} FROM daygrid",
)
def _(spark, sf):
    return I.rounded(I.daygrid(spark, sf), ["aqi", "pm25", "pm10"])


@check(
    "w7_forward_fill_limited",
    I.with_(I.READINGS, I.GAPPY, I.HOURLY)
    + """SELECT station, date, round(last_value(aqi IGNORE NULLS) OVER w, 6) AS aqi,
      round(last_value(pm25 IGNORE NULLS) OVER w, 6) AS pm25 FROM hourly
      WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    filled = fill.forward_fill(I.hourly(spark, sf), ["aqi", "pm25"], 3, I.timeline())
    return I.rounded(filled, ["aqi", "pm25"])


@check(
    "w8_fill_both_ways",
    I.with_(I.READINGS, I.GAPPY)
    + """SELECT event_id, round(coalesce(last_value(aqi IGNORE NULLS) OVER b, first_value(aqi IGNORE NULLS) OVER f), 6) AS aqi,
      round(coalesce(last_value(pm25 IGNORE NULLS) OVER b, first_value(pm25 IGNORE NULLS) OVER f), 6) AS pm25 FROM gappy
      WINDOW b AS (PARTITION BY station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def _(spark, sf):
    filled = fill.fill_both_ways(I.gappy(spark, sf), ["aqi", "pm25"], I.timeline())
    return I.rounded(filled.select("event_id", "aqi", "pm25"), ["aqi", "pm25"])


def _interpolation(axis: str) -> str:
    """SQL for linear interpolation of gappy.aqi and gappy.pm25 along ``axis``."""
    parts = []
    for c in ("aqi", "pm25"):
        parts.append(
            f"""last_value({c} IGNORE NULLS) OVER b AS p_{c}, first_value({c} IGNORE NULLS) OVER f AS n_{c},
            last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt_{c},
            first_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt_{c}"""
        )
    final = ", ".join(
        f"""round(CASE WHEN {c} IS NOT NULL THEN {c} WHEN p_{c} IS NULL THEN n_{c} WHEN n_{c} IS NULL THEN p_{c}
        ELSE p_{c} + (n_{c} - p_{c}) * (CAST(t - pt_{c} AS DOUBLE) / CAST(nt_{c} - pt_{c} AS DOUBLE)) END, 6) AS {c}"""
        for c in ("aqi", "pm25")
    )
    return (
        I.with_(I.READINGS, I.GAPPY)
        + f""", axis AS (SELECT *, {axis} AS t FROM gappy), known AS (SELECT *, {', '.join(parts)} FROM axis
      WINDOW b AS (PARTITION BY station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, {final} FROM known"""
    )


@check("w9_time_interpolation", _interpolation("epoch_us(date)"))
def _(spark, sf):
    filled = fill.interpolate(I.gappy(spark, sf), ["aqi", "pm25"], "time", I.timeline())
    return I.rounded(filled.select("event_id", "aqi", "pm25"), ["aqi", "pm25"])


@check(
    "w10_row_interpolation", _interpolation("row_number() OVER (PARTITION BY station ORDER BY date)")
)
def _(spark, sf):
    filled = fill.interpolate(I.gappy(spark, sf), ["aqi", "pm25"], "row", I.timeline())
    return I.rounded(filled.select("event_id", "aqi", "pm25"), ["aqi", "pm25"])


@check(
    "w7_impute_ffill_strategy",
    I.with_(I.DAILY, I.DAYGRID)
    + """, held AS (SELECT station, date, last_value(aqi IGNORE NULLS) OVER
        (PARTITION BY station ORDER BY date ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS aqi FROM daygrid)
    SELECT station, date, round(first_value(aqi IGNORE NULLS) OVER (PARTITION BY station ORDER BY date
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS aqi FROM held""",
)
def _(spark, sf):
    g = I.daygrid(spark, sf).select("station", "date", "aqi")
    return I.rounded(fill.impute(g, ["aqi"], "ffill", timeline=I.timeline()), ["aqi"])


@check(
    "a10_column_medians",
    I.with_(I.READINGS, I.GAPPY)
    + """SELECT station, 'aqi' AS variable, round(quantile_cont(aqi, 0.5), 6) AS median FROM gappy GROUP BY 1
    UNION ALL SELECT station, 'pm25', round(quantile_cont(pm25, 0.5), 6) FROM gappy GROUP BY 1""",
)
def _(spark, sf):
    return I.rounded(fill.medians(I.gappy(spark, sf), ["aqi", "pm25"]), ["median"])


@check(
    "a10_median_fill",
    I.with_(I.READINGS, I.GAPPY)
    + """, med AS (SELECT station, quantile_cont(aqi, 0.5) AS m FROM gappy GROUP BY 1)
    SELECT event_id, round(coalesce(g.aqi, med.m), 6) AS aqi FROM gappy g JOIN med USING (station)""",
)
def _(spark, sf):
    g = I.gappy(spark, sf).select("event_id", "station", "aqi")
    return I.rounded(fill.fill_with_medians(g, ["aqi"], fill.medians(g, ["aqi"])), ["aqi"]).drop("station")


@check(
    "a6_temporal_coverage",
    I.with_(I.READINGS, I.GAPPY, I.HOURLY)
    + """SELECT station, count(*) AS actual, CAST(date_diff('hour', min(date), max(date)) + 1 AS BIGINT) AS expected,
      round(count(*) * 100.0 / CAST(date_diff('hour', min(date), max(date)) + 1 AS DOUBLE), 6) AS coverage_pct
    FROM hourly WHERE aqi IS NOT NULL GROUP BY station""",
)
def _(spark, sf):
    present = I.hourly(spark, sf).where(F.col("aqi").isNotNull())
    return I.rounded(grid.temporal_coverage(present, "HOUR"), ["coverage_pct"])
