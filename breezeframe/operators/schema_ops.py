"""Header, type and range work on raw frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import schema as S
from ..functions.numeric import at_least, to_number


class SchemaError(ValueError):
    """A frame does not satisfy the canonical schema."""


def trim_all(df: DataFrame) -> DataFrame:
    """Trim column names and every string cell."""
    named = df.toDF(*[c.strip() for c in df.columns])
    texts = {f.name: F.trim(F.col(f"`{f.name}`")) for f in named.schema if _is_text(f)}
    return named.withColumns(texts) if texts else named


def rename_aliases(df: DataFrame) -> DataFrame:
    """Rename known raw headers; two headers for one column are an error, not a silent choice."""
    names = [S.ALIASES.get(c, c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise SchemaError(f"several headers map to {clash}")
    return df.toDF(*names)


def renamed_headers(columns: Sequence[str]) -> dict[str, str]:
    return {c: S.ALIASES[c] for c in columns if S.ALIASES.get(c, c) != c}


def attach_station(df: DataFrame, station: str) -> DataFrame:
    """Add a constant station when the column is absent, else trim it."""
    if "station" in df.columns:
        return df.withColumn("station", F.trim(F.col("station").cast("string")))
    return df.withColumn("station", F.lit(station))


def parse_timestamp(c: Column) -> Column:
    """First format that fits, decided per value; null when none does."""
    text = F.trim(c.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in S.TIMESTAMP_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def coerce(df: DataFrame) -> DataFrame:
    """Type canonical columns; unreadable numbers and dates become null."""
    cols = {}
    for f in df.schema:
        spec = next((s for s in S.SPECS if s.name == f.name), None)
        kind = spec.kind if spec else ("double" if f.name in S.EXTENDED else None)
        if kind == "double" and not isinstance(f.dataType, T.DoubleType):
            cols[f.name] = to_number(F.col(f.name))
        elif kind == "double":
            cols[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
        elif kind == "timestamp" and _is_text(f):
            cols[f.name] = parse_timestamp(F.col(f.name))
        elif kind == "string":
            cols[f.name] = F.col(f.name).cast("string")
    return df.withColumns(cols) if cols else df


def coercion_losses(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells per column that held text but no number."""
    lost = [
        F.count_if(F.col(c).isNotNull() & to_number(F.col(c)).isNull()).alias(c) for c in columns
    ]
    return raw.agg(*lost).unpivot([], list(columns), "variable", "newly_null")


def missing_columns(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    have = set(columns)
    return [c for c in S.REQUIRED if c not in have], [c for c in S.OPTIONAL if c not in have]


def validate(df: DataFrame, *, strict: bool = False) -> DataFrame:
    """Canonical names and types; absent optional columns are added as null."""
    named = rename_aliases(df)
    required, optional = missing_columns(named.columns)
    problems = [f"required column '{c}' is missing" for c in required]
    if strict:
        problems += [f"optional column '{c}' is missing" for c in optional]
    if problems:
        raise SchemaError("; ".join(problems))
    typed = coerce(named)
    return typed.withColumns({c: F.lit(None).cast("double") for c in optional}) if optional else typed


def unknown_columns(columns: Sequence[str]) -> list[str]:
    canonical = {s.name for s in S.SPECS}
    return [c for c in columns if c not in canonical]


def range_violations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: values outside the physical limits, and their share of known values."""
    cols = [c for c in (columns or S.NUMERIC) if c in df.columns and c in S.LIMITS]
    aggs = [
        F.struct(
            F.count_if(~F.col(c).between(*S.LIMITS[c])).alias("violations"),
            F.count(c).alias("known"),
        ).alias(c)
        for c in cols
    ]
    long = df.agg(*aggs).unpivot([], cols, "variable", "s")
    return long.select(
        "variable",
        F.col("s.violations").alias("violations"),
        F.when(F.col("s.known") > 0, F.col("s.violations") * 100.0 / F.col("s.known")).alias("pct"),
    )


def clip_non_negative(df: DataFrame) -> DataFrame:
    cols = [c for c in S.NON_NEGATIVE if c in df.columns]
    return df.withColumns({c: at_least(F.col(c), 0.0) for c in cols}) if cols else df


def low_coverage_columns(
    df: DataFrame, columns: Sequence[str], min_valid: float
) -> list[str]:
    """Columns known in fewer than ``min_valid`` of the rows (one aggregate, one driver row)."""
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0.0) < min_valid]


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    shares = [F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]
    return df.agg(*shares).unpivot([], list(columns), "variable", "valid_share")


def drop_incomplete(df: DataFrame, columns: Sequence[str] = S.KEY_COLUMNS_FOR_DROP) -> DataFrame:
    return df.dropna(subset=[c for c in columns if c in df.columns])


def as_observations(df: DataFrame, station: str) -> DataFrame:
    """An in-memory frame as a source: aliases, station, dates (null dates dropped), numbers."""
    named = attach_station(rename_aliases(df), station)
    return coerce(named).where(F.col("date").isNotNull())


def _is_text(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)
