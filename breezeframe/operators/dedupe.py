"""Duplicate removal by aggregation, so that a heavily repeated key shrinks before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.schema import KEY


def keep_first(df: DataFrame, priority: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """One row per key: the lowest ``priority``, then the lowest remaining values; a null never wins over a value.

    Each map task keeps one candidate per key, so a key with very many copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in priority]
    # Nulls sort first, so each value is preceded by whether it is missing.
    ranked = [x for c in (*priority, *rest) for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_best"))
    return best.select(*[c if c in keys else F.col("_best").getField(c).alias(c) for c in df.columns])


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a frame become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_sources(frames: Sequence[DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """Concatenate sources; on equal keys the source listed first wins."""
    ranked = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    return keep_first(concat_frames(ranked), ["_source"], keys).drop("_source")


def duplicate_counts(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Surplus rows per station: rows minus distinct keys."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(keys[0]).agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates")
    )
