"""Gap filling per station on segmented timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.quantiles import quantiles
from ..core.shared import materialise
from ..core.timeline import Timeline
from .schema_ops import drop_incomplete

SHORT_GAP = 3
LONG_GAP = 24


def forward_fill(
    df: DataFrame, columns: Sequence[str], limit: int = SHORT_GAP, timeline: Timeline = Timeline()
) -> DataFrame:
    """Carry the last value over at most ``limit`` rows."""
    filled = timeline.select(
        df,
        lambda f: {c: F.last(c, True).over(f.rows(-limit, 0)) for c in columns},
        before=limit,
    )
    return filled.select(*df.columns)


def fill_both_ways(
    df: DataFrame, columns: Sequence[str], timeline: Timeline = Timeline()
) -> DataFrame:
    """Forward fill without limit, then backward fill."""
    filled = timeline.select(
        df,
        lambda f: {c: F.coalesce(f.last_known(c), f.next_known(c)) for c in columns},
        carry=columns,
    )
    return filled.select(*df.columns)


def interpolate(
    df: DataFrame, columns: Sequence[str], axis: str = "time", timeline: Timeline = Timeline()
) -> DataFrame:
    """Linear in elapsed time (``time``) or in row position (``row``); edges take the nearest value."""
    if axis == "row":
        numbered = timeline.number(df, "_at")
        by_row = Timeline(timeline.key, "_at", (), timeline.rows, timeline.rows)
        return _interpolate(numbered, columns, by_row).select(*df.columns)
    if axis != "time":
        raise ValueError(f"unknown interpolation axis '{axis}'")
    return _interpolate(df, columns, timeline).select(*df.columns)


def _interpolate(df: DataFrame, columns: Sequence[str], timeline: Timeline) -> DataFrame:
    order = timeline.order
    kind = df.schema[order].dataType

    def between(a: Column, b: Column) -> Column:
        if isinstance(kind, T.DateType):
            return F.date_diff(b, a).cast("double")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.timestamp_diff("MICROSECOND", a, b).cast("double")
        return (b - a).cast("double")

    def build(f):
        out = {}
        for c in columns:
            prev, nxt = f.last_known(c), f.next_known(c)
            at, next_at = f.last_known_at(c, order), f.next_known_at(c, order)
            share = between(at, F.col(order)) / between(at, next_at)
            out[c] = F.coalesce(F.col(c), prev + (nxt - prev) * share, prev, nxt)
        return out

    return timeline.select(df, build, carry=columns)


def medians(df: DataFrame, columns: Sequence[str], key: str = "station") -> DataFrame:
    """Median per station and column (long form), the last resort of ``impute``."""
    long = df.unpivot([key], list(columns), "variable", "value")
    q = quantiles(long, [key, "variable"], "value", {"median": 0.5})
    return materialise(q.drop("n"), "medians")


def fill_with_medians(
    df: DataFrame, columns: Sequence[str], learned: DataFrame, key: str = "station"
) -> DataFrame:
    """Replace remaining nulls by learned medians, 0 where a column never had a value."""
    wide = learned.groupBy(key).agg(
        *[F.max(F.when(F.col("variable") == c, F.col("median"))).alias(f"_m_{c}") for c in columns]
    )
    joined = df.join(materialise(wide, "wide-medians"), key, "left")
    fills = {c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}
    return joined.withColumns(fills).select(*df.columns)


def impute(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "interpolate",
    axis: str = "time",
    learned: DataFrame | None = None,
    timeline: Timeline = Timeline(),
) -> DataFrame:
    """``interpolate``, ``ffill`` (24 rows, then backward) or ``drop`` (rows without key values)."""
    if strategy == "interpolate":
        filled = interpolate(df, columns, axis, timeline)
        return filled if learned is None else fill_with_medians(filled, columns, learned)
    if strategy == "ffill":
        held = timeline.select(
            df,
            lambda f: {c: F.last(c, True).over(f.rows(-LONG_GAP, 0)) for c in columns},
            before=LONG_GAP,
        )
        back = timeline.select(
            held, lambda f: {c: f.next_known(c) for c in columns}, carry=columns
        )
        return back.select(*df.columns)
    if strategy == "drop":
        return drop_incomplete(df)
    raise ValueError(f"unknown missing-value strategy '{strategy}'")
