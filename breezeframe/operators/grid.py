"""Regular time grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60}
# Steps finer than a day are generated day by day, which keeps each generated array short.
_INTERVAL = {"DAY": "INTERVAL 1 DAY", "HOUR": "INTERVAL 1 HOUR", "MINUTE": "INTERVAL 1 MINUTE"}


def slot(c: str, df: DataFrame, step: str) -> Column:
    if isinstance(df.schema[c].dataType, T.DateType):
        if step != "DAY":
            raise ValueError("a date column only has a DAY grid")
        return F.col(c)
    return F.date_trunc(step, c)


def spine(span: DataFrame, step: str, lo: str = "lo", hi: str = "hi", name: str = "date") -> DataFrame:
    """Every slot from ``lo`` to ``hi`` for each row of ``span``."""
    rest = [c for c in span.columns if c not in (lo, hi)]
    if step == "DAY":
        seq = F.sequence(lo, hi, F.expr(_INTERVAL["DAY"]))
        return span.select(*rest, F.explode(seq).alias(name))
    days = span.select(
        *rest,
        lo,
        hi,
        F.explode(
            F.sequence(F.date_trunc("DAY", lo), F.date_trunc("DAY", hi), F.expr(_INTERVAL["DAY"]))
        ).alias("_day"),
    )
    last = F.col("_day") + F.expr("INTERVAL 1 DAY") - F.expr(_INTERVAL[step])
    slots = F.sequence(F.col("_day"), last, F.expr(_INTERVAL[step]))
    return (
        days.select(*rest, lo, hi, F.explode(slots).alias(name))
        .where(F.col(name).between(F.col(lo), F.col(hi)))
        .drop(lo, hi)
    )


def resample(
    df: DataFrame,
    columns: Sequence[str],
    step: str = "HOUR",
    key: str = "station",
    order: str = "date",
) -> DataFrame:
    """Mean per slot between a station's first and last reading; empty slots are kept as null."""
    at = slot(order, df, step)
    means = df.groupBy(key, at.alias(order)).agg(*[F.avg(c).alias(c) for c in columns])
    span = df.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    return spine(span, step, name=order).join(means, [key, order], "left").select(
        key, order, *columns
    )


def temporal_coverage(
    df: DataFrame, step: str = "HOUR", key: str = "station", order: str = "date"
) -> DataFrame:
    """Rows present against slots expected per station."""
    at = slot(order, df, step)
    lo, hi = F.min(at), F.max(at)
    if isinstance(df.schema[order].dataType, T.DateType):
        expected = F.date_diff(hi, lo) + 1
    else:
        expected = F.floor(F.timestamp_diff("SECOND", lo, hi) / STEPS[step]) + 1
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("actual"), expected.cast("bigint").alias("expected"))
        .withColumn("coverage_pct", F.col("actual") * 100.0 / F.col("expected"))
    )
