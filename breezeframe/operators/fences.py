"""Outlier fences: learning, tightening, applying and reporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.quantiles import quantiles
from ..core.schema import LIMITS
from ..core.shared import materialise
from ..functions.numeric import clamp

# --- Fixed values: thresholds of the three methods --------------------------
MIN_VALUES = 20
MIN_VALUES_OLD = 10
THRESHOLD = 3.0
NORMAL_MAD = 0.6745
Z_SCALE = 1.167
TAIL_FACTOR = 1.5


def _long(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    return df.unpivot([key], list(columns), "variable", "value")


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = THRESHOLD, key: str = "station") -> DataFrame:
    q = quantiles(_long(df, columns, key), [key, "variable"], "value", {"q1": 0.25, "q3": 0.75})
    return q.select(key, "variable", "n", *_iqr(F.col("q1"), F.col("q3"), k))


def _iqr(q1: Column, q3: Column, k: float) -> list[Column]:
    spread = q3 - q1
    return [(q1 - k * spread).alias("lower"), (q3 + k * spread).alias("upper")]


def zscore_fences(df: DataFrame, columns: Sequence[str], k: float = THRESHOLD, key: str = "station") -> DataFrame:
    stats = _long(df, columns, key).groupBy(key, "variable").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("_m"),
        F.stddev_samp("value").alias("_s"),
    )
    return stats.select(
        key,
        "variable",
        "n",
        (F.col("_m") - k * F.col("_s")).alias("lower"),
        (F.col("_m") + k * F.col("_s")).alias("upper"),
    )


def modified_zscore_fences(
    df: DataFrame, columns: Sequence[str], k: float = THRESHOLD, key: str = "station"
) -> DataFrame:
    """Median and median absolute deviation; a zero deviation falls back to the IQR fence."""
    long = _long(df, columns, key)
    group = [key, "variable"]
    q = quantiles(long, group, "value", {"med": 0.5, "q1": 0.25, "q3": 0.75})
    q = materialise(q.withColumnRenamed("n", "n_values"), "centres")
    # The centres travel as grouping columns, so no join back is needed.
    carried = [*group, "med", "q1", "q3", "n_values"]
    deviations = long.join(q, group)
    spread = quantiles(deviations, carried, F.abs(F.col("value") - F.col("med")), {"mad": 0.5})
    half = F.lit(k * Z_SCALE) * F.col("mad") / F.lit(NORMAL_MAD)
    lo, hi = _iqr(F.col("q1"), F.col("q3"), k)
    return spread.select(
        *group,
        F.col("n_values").alias("n"),
        F.when(F.col("mad") == 0, lo).otherwise(F.col("med") - half).alias("lower"),
        F.when(F.col("mad") == 0, hi).otherwise(F.col("med") + half).alias("upper"),
    )


METHODS = {"iqr": iqr_fences, "zscore": zscore_fences, "modified_zscore": modified_zscore_fences}


def tighten(fences: DataFrame) -> DataFrame:
    """Never let a fence reach beyond the physical limits of its column."""
    lows = F.create_map(*[F.lit(x) for c, (lo, _) in LIMITS.items() for x in (c, lo)])
    highs = F.create_map(*[F.lit(x) for c, (_, hi) in LIMITS.items() for x in (c, hi)])
    # greatest/least skip nulls, so columns without limits keep their fence.
    return fences.withColumns(
        {
            "lower": F.greatest("lower", F.try_element_at(lows, F.col("variable"))),
            "upper": F.least("upper", F.try_element_at(highs, F.col("variable"))),
        }
    )


def learn(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    k: float = THRESHOLD,
    min_values: int = MIN_VALUES,
    key: str = "station",
) -> DataFrame:
    """Fences per station and column (long form), for columns with enough values."""
    if method not in METHODS:
        raise ValueError(f"unknown outlier method '{method}'")
    enough = METHODS[method](df, columns, k, key).where(F.col("n") >= min_values)
    return materialise(tighten(enough).drop("n"), "fences")


def _wide(fences: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    aggs = []
    for c in columns:
        mine = F.col("variable") == c
        aggs += [
            F.max(F.when(mine, F.col("lower"))).alias(f"_lo_{c}"),
            F.max(F.when(mine, F.col("upper"))).alias(f"_hi_{c}"),
        ]
    return fences.groupBy(key).agg(*aggs)


def _outside(c: str) -> Column:
    bad = (F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))
    return F.coalesce(bad, F.lit(False))


def apply(
    df: DataFrame,
    fences: DataFrame,
    columns: Sequence[str],
    treatment: str = "cap",
    key: str = "station",
) -> DataFrame:
    """``cap`` to the fence, ``nan`` to null, or ``drop`` rows with any value outside."""
    joined = df.join(materialise(_wide(fences, columns, key), "wide-fences"), key, "left")
    if treatment == "cap":
        fixed = {
            c: F.when(
                F.col(f"_lo_{c}").isNotNull(),
                clamp(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")),
            ).otherwise(F.col(c))
            for c in columns
        }
        return joined.withColumns(fixed).select(*df.columns)
    if treatment == "nan":
        return joined.withColumns(
            {c: F.when(~_outside(c), F.col(c)) for c in columns}
        ).select(*df.columns)
    if treatment == "drop":
        any_bad = F.lit(False)
        for c in columns:
            any_bad = any_bad | _outside(c)
        return joined.where(~any_bad).select(*df.columns)
    raise ValueError(f"unknown outlier treatment '{treatment}'")


def summary(
    df: DataFrame, fences: DataFrame, columns: Sequence[str], key: str = "station"
) -> DataFrame:
    """Fence and number of values outside it, per station and column."""
    outside = (
        _long(df, columns, key)
        .join(fences, [key, "variable"])
        .groupBy(key, "variable")
        .agg(
            F.max("lower").alias("lower"),
            F.max("upper").alias("upper"),
            F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias(
                "treated"
            ),
        )
    )
    return outside.select(
        key,
        "variable",
        F.round("lower", 3).alias("lower_bound"),
        F.round("upper", 3).alias("upper_bound"),
        "treated",
    )


def upper_tail(df: DataFrame, columns: Sequence[str], factor: float = TAIL_FACTOR) -> DataFrame:
    """Values above q3 + factor * iqr per column, over all stations."""
    long = df.select(*columns).unpivot([], list(columns), "variable", "value")
    q = quantiles(long, ["variable"], "value", {"q1": 0.25, "q3": 0.75})
    threshold = F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    q = materialise(q.select("variable", threshold.alias("threshold")), "thresholds")
    return (
        long.join(q, "variable")
        .groupBy("variable")
        .agg(
            F.max("threshold").alias("threshold"),
            F.count_if(F.col("value") > F.col("threshold")).alias("outliers"),
        )
    )
