"""Readers for station files, feature tables and report text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.schema import ALIASES
from ..operators import dedupe, report_text
from ..operators.schema_ops import attach_station, parse_timestamp, rename_aliases, trim_all

DATE_HEADERS = tuple(a for a, c in ALIASES.items() if c == "date") + ("date",)


def probe_files(spark: SparkSession, folder: str, pattern: str) -> list[dict]:
    """Header, separator and encoding of every matching file, from one distributed text scan.

    The header is the first line of a file that is not blank, if it names a date column; no later line is one.
    """
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            # Rows of one block come in order, so the smallest number in the first block is the first line.
            F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"),
        )
    )
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    )
    start = F.col("at").isNotNull() & (F.trim(text) != "")
    per_file = lines.groupBy("path").agg(
        F.min(F.when(start, F.struct("at", text.alias("line")))).alias("first"),
        F.max(~F.is_valid_utf8("value")).alias("broken"),
    ).select("path", F.when(_is_header(F.col("first.line")), F.col("first.line")).alias("header"), "broken")
    try:
        rows = per_file.collect()  # one row per file, like the file listing itself
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []
    return [
        {
            "path": r["path"],
            "header": r["header"],
            "sep": _separator(r["header"]),
            "encoding": "ISO-8859-1" if r["broken"] else "UTF-8",
        }
        for r in rows
    ]


def _is_header(line: Column) -> Column:
    clean = F.replace(F.replace(line, F.lit('"'), F.lit("")), F.lit("﻿"), F.lit(""))
    tokens = F.transform(F.split(clean, "[,;]"), lambda t: F.trim(t))
    return F.arrays_overlap(tokens, F.array(*[F.lit(h) for h in DATE_HEADERS]))


def _separator(header: str | None) -> str:
    text = header or ""
    return ";" if text.count(";") > text.count(",") else ","


def scan_station_files(
    spark: SparkSession,
    folder: str,
    station: str,
    pattern: str | None = None,
    datetime_column: str | None = None,
) -> DataFrame:
    """All CSV files of a station as trimmed text, dates parsed, duplicates removed.

    Without ``pattern`` the files named after the station are read, else every CSV file in the folder.
    Files may differ in columns, separator and encoding.
    """
    files = probe_files(spark, folder, pattern or f"{station}*.csv")
    if not files:
        files = probe_files(spark, folder, "*.csv")
    if not files:
        raise FileNotFoundError(f"no CSV files for station '{station}' in {folder}")
    headless = [f["path"] for f in files if f["header"] is None]
    if headless:
        raise ValueError(f"no date column in {headless}")
    groups: dict[tuple, list[str]] = {}
    for f in files:
        groups.setdefault((f["header"], f["sep"], f["encoding"]), []).append(f["path"])
    frames = []
    for (header, sep, encoding), paths in sorted(groups.items()):
        names = [h.strip().strip('"').lstrip("﻿") for h in header.split(sep)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = (
            spark.read.schema(schema)
            .options(header=True, sep=sep, encoding=encoding, enforceSchema=True)
            .csv(paths)
            .withColumn("_file", F.col("_metadata.file_name"))
        )
        frames.append(rename_aliases(trim_all(raw)))
    merged = dedupe.concat_frames(frames)
    if datetime_column and datetime_column in merged.columns:
        merged = merged.withColumnRenamed(datetime_column, "date")
    dated = attach_station(merged, station).withColumn("date", parse_timestamp(F.col("date")))
    return dedupe.keep_first(dated, ["_file"]).drop("_file")


def load_external(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv"
) -> DataFrame:
    """Holiday, weather and similar tables with a declared schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    fmt: str = "parquet",
    dates: Sequence[str] = (),
) -> DataFrame:
    """Typed feature table; text columns listed in ``dates`` are parsed."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return df.withColumns({d: parse_timestamp(F.col(d)) for d in dates}) if dates else df


def scan_report_text(spark: SparkSession, path: str) -> DataFrame:
    """Report text to rows of ``cells``; ``source`` is the partition folder if named so, else the file."""
    lines = spark.read.text(path)
    if "source" not in lines.columns:
        lines = lines.select("value", F.col("_metadata.file_name").alias("source"))
    return report_text.parse_lines(lines)
