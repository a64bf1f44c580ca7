"""As-of lookups without comparing every probe with every reading.

Probes and readings are interleaved on one timeline; the neighbouring reading is then a fill, which costs
one shuffle and no pairwise comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.timeline import Timeline


def _interleave(
    times: DataFrame, readings: DataFrame, values: Sequence[str], key: str, on: str, times_first: bool
) -> DataFrame:
    r = readings.select(
        key,
        on,
        F.lit(1 if times_first else 0).alias("_kind"),
        F.struct(F.col(on).alias("_at"), *values).alias("_r"),
    )
    return r.unionByName(
        times.select(key, on, F.lit(0 if times_first else 1).alias("_kind")), allowMissingColumns=True
    )


def _times(probes: DataFrame, key: str, on: str) -> DataFrame:
    """Each probed moment once: many probes of one moment collapse before the shuffle."""
    return probes.select(key, on).distinct()


def _distance(df: DataFrame, on: str, a: Column, b: Column) -> Column:
    kind = df.schema[on].dataType
    if isinstance(kind, T.DateType):
        return F.date_diff(b, a)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_diff("MICROSECOND", a, b)
    return b - a


def nearest(
    probes: DataFrame,
    readings: DataFrame,
    values: Sequence[str],
    key: str = "station",
    on: str = "date",
    timeline: Timeline | None = None,
) -> DataFrame:
    """Per probe the reading of its key with the least time difference, the earlier one on a tie."""
    base = timeline or Timeline()
    tl = Timeline((key,), on, ("_kind",), base.grain, base.rows)
    mixed = _interleave(_times(probes, key, on), readings, values, key, on, times_first=False)
    found = tl.select(
        mixed, lambda f: {"_prev": f.last_known("_r"), "_next": f.next_known("_r")}, carry=["_r"]
    ).where(F.col("_kind") == 1)
    back = _distance(mixed, on, F.col("_prev._at"), F.col(on))
    ahead = _distance(mixed, on, F.col(on), F.col("_next._at"))
    pick = F.when(
        F.col("_next").isNull() | (F.col("_prev").isNotNull() & (back <= ahead)), F.col("_prev")
    ).otherwise(F.col("_next"))
    hits = found.withColumn("_hit", pick).select(
        key, on, F.col("_hit._at").alias("matched_date"), *[F.col(f"_hit.{c}").alias(c) for c in values]
    )
    return probes.join(hits, [key, on], "left")


def last_before(
    probes: DataFrame,
    readings: DataFrame,
    n: int,
    values: Sequence[str],
    key: str = "station",
    on: str = "date",
    timeline: Timeline | None = None,
) -> DataFrame:
    """The ``n`` readings strictly before each probe; with fewer, the last ``n`` of the series.

    Positions turn the inequality into an equality join: a probe needs positions k-n .. k-1.
    """
    base = timeline or Timeline()
    numbered = Timeline((key,), on, (), base.grain, base.rows).number(
        readings.select(key, on, *values), "_pos", total="_n"
    )
    tl = Timeline((key,), on, ("_kind",), base.grain, base.rows)
    mixed = _interleave(_times(probes, key, on), numbered, ["_pos", "_n"], key, on, times_first=True)
    placed = tl.select(
        mixed, lambda f: {"_prev": f.last_known("_r"), "_next": f.next_known("_r")}, carry=["_r"]
    ).where(F.col("_kind") == 0)
    # Either neighbour knows the length of the series; a moment without any has no readings at all.
    total = F.coalesce("_prev._n", "_next._n")
    k = F.coalesce(F.col("_prev._pos") + 1, F.lit(0))
    end = F.when(k >= n, k).otherwise(total)
    wanted = placed.where(total.isNotNull()).select(
        key,
        F.col(on).alias("_probe_at"),
        F.explode(F.sequence(F.greatest(F.lit(0), end - n), end - 1)).alias("_pos"),
        end.alias("_end"),
    )
    rows = numbered.select(key, "_pos", F.col(on).alias("matched_date"), *values)
    hits = wanted.join(rows, [key, "_pos"]).select(
        key,
        F.col("_probe_at").alias(on),
        (F.col("_end") - F.col("_pos")).cast("int").alias("back"),
        "matched_date",
        *values,
    )
    return probes.join(hits, [key, on])
