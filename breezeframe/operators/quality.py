"""Completeness, gap and score reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.schema import LIMITS, QUALITY_LIMITS
from ..core.timeline import Frame, Timeline
from ..functions.air import CLASS_TITLES, aqi_class
from . import grid

# --- Fixed values: weights of the scores ------------------------------------
MISSING_WEIGHT, RUN_WEIGHT = 2.0, 0.5
COMPLETE_WEIGHT, RANGE_WEIGHT = 60.0, 40.0
COLUMN_SHARE, COVERAGE_SHARE = 0.70, 0.30
GAP_FACTOR = 3
MIN_VALID = 0.60


def longest_null_runs(
    df: DataFrame, columns: Sequence[str], timeline: Timeline = Timeline()
) -> DataFrame:
    """Longest run of consecutive nulls per station and column (long form).

    Inside a segment a run is the distance between two known positions; runs that cross segments are
    closed on the table of first and last known positions per segment.
    """
    numbered = timeline.select(
        df.select(*timeline.key, timeline.order, *timeline.tie, *columns),
        lambda f: {"_pos": f.position(), "_n": F.col("_total")},
        segment_as="_s",
    )
    w = Window.partitionBy(*timeline.key, "_s").orderBy("_pos")
    strictly_before = w.rowsBetween(Window.unboundedPreceding, -1)
    gaps = {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.col("_pos"))
        gaps[f"_k_{c}"] = known
        gaps[f"_g_{c}"] = known - F.max(known).over(strictly_before) - 1
    per_segment = (
        numbered.withColumns(gaps)
        .groupBy(*timeline.key, "_s")
        .agg(
            F.max("_n").alias("_n"),
            *[
                F.struct(
                    F.max(f"_g_{c}").alias("gap"),
                    F.min(f"_k_{c}").alias("first"),
                    F.max(f"_k_{c}").alias("last"),
                ).alias(c)
                for c in columns
            ],
        )
        .unpivot([*timeline.key, "_s", "_n"], list(columns), "variable", "v")
    )
    group = [*timeline.key, "variable"]
    earlier = (
        Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    )
    crossing = F.col("v.first") - F.coalesce(F.max("v.last").over(earlier), F.lit(-1)) - 1
    return (
        per_segment.withColumn("_cross", crossing)
        .groupBy(*group)
        .agg(
            F.greatest(
                F.max("v.gap"),
                F.max("_cross"),
                F.max("_n") - 1 - F.coalesce(F.max("v.last"), F.lit(-1)),
            )
            .cast("bigint")
            .alias("longest_run")
        )
    )


def missing_report(
    df: DataFrame, columns: Sequence[str], timeline: Timeline = Timeline()
) -> DataFrame:
    """Missing count, share, longest run and the missing score per station and column."""
    counts = (
        df.unpivot(["station"], list(columns), "variable", "value")
        .groupBy("station", "variable")
        .agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count(F.lit(1)).alias("_n"))
    )
    pct = F.col("missing") * 100.0 / F.col("_n")
    score = 100.0 - MISSING_WEIGHT * pct - RUN_WEIGHT * F.col("longest_run")
    return counts.join(longest_null_runs(df, columns, timeline), ["station", "variable"]).select(
        "station",
        "variable",
        "missing",
        F.round(pct, 2).alias("missing_pct"),
        "longest_run",
        F.round(F.greatest(F.lit(0.0), score), 1).alias("score"),
    )


def column_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """60 points for completeness, 40 for values inside the physical limits."""
    aggs = []
    for c in columns:
        known = F.count(c)
        inside = F.count_if(F.col(c).between(*LIMITS[c])) if c in LIMITS else known
        share = F.when(known > 0, inside / known).otherwise(1.0 if c not in LIMITS else 0.0)
        points = COMPLETE_WEIGHT * (known / F.count(F.lit(1))) + RANGE_WEIGHT * share
        aggs.append(F.round(points, 1).alias(c))
    return df.groupBy("station").agg(*aggs).unpivot(["station"], list(columns), "variable", "score")


def overall_score(df: DataFrame, columns: Sequence[str], step: str = "HOUR") -> DataFrame:
    """Mean column score weighted with the temporal coverage per station."""
    scores = column_scores(df, columns).groupBy("station").agg(F.avg("score").alias("_mean"))
    covered = grid.temporal_coverage(df, step).select("station", "coverage_pct")
    total = COLUMN_SHARE * F.col("_mean") + COVERAGE_SHARE * F.col("coverage_pct")
    return scores.join(covered, "station").select(
        "station", F.round("coverage_pct", 4).alias("coverage_pct"), F.round(total, 1).alias("overall")
    )


def class_distribution(df: DataFrame, column: str = "aqi") -> DataFrame:
    """Rows and share per air-quality class and station; empty classes are listed with zero."""
    cls = aqi_class(F.col(column))
    total = F.count(cls)
    parts = [
        F.struct(
            F.lit(i).alias("class"), F.lit(t).alias("label"), F.count_if(cls == i).alias("n")
        )
        for i, t in enumerate(CLASS_TITLES)
    ]
    wide = df.groupBy("station").agg(F.array(*parts).alias("_p"), total.alias("_t"))
    return wide.select("station", F.explode("_p").alias("_c"), "_t").select(
        "station",
        F.col("_c.class").alias("class"),
        F.col("_c.label").alias("label"),
        F.col("_c.n").alias("n"),
        F.when(F.col("_t") > 0, F.round(F.col("_c.n") * 100.0 / F.col("_t"), 1))
        .otherwise(0.0)
        .alias("pct"),
    )


def quality_check(
    df: DataFrame, columns: Sequence[str], min_valid: float = MIN_VALID
) -> DataFrame:
    """The older check: missing and out-of-range shares, extremes, mean and a pass flag per column."""
    aggs = []
    for c in columns:
        oor = (
            F.count_if(~F.col(c).between(*QUALITY_LIMITS[c]))
            if c in QUALITY_LIMITS
            else F.lit(0).cast("bigint")
        )
        aggs.append(
            F.struct(
                F.count(F.lit(1)).alias("n"),
                F.count(c).alias("known"),
                oor.alias("oor"),
                F.min(c).alias("lo"),
                F.max(c).alias("hi"),
                F.avg(c).alias("mean"),
            ).alias(c)
        )
    long = df.agg(*aggs).unpivot([], list(columns), "variable", "s")
    missing = F.col("s.n") - F.col("s.known")
    return long.select(
        "variable",
        missing.alias("missing"),
        F.round(missing * 100.0 / F.col("s.n"), 2).alias("missing_pct"),
        F.col("s.oor").alias("out_of_range"),
        F.when(F.col("s.known") > 0, F.round(F.col("s.oor") * 100.0 / F.col("s.known"), 2))
        .otherwise(0.0)
        .alias("out_of_range_pct"),
        F.round("s.lo", 3).alias("min"),
        F.round("s.hi", 3).alias("max"),
        F.round("s.mean", 3).alias("mean"),
        (F.col("s.known") / F.col("s.n") >= min_valid).cast("int").alias("passed"),
    )


def time_gaps(
    df: DataFrame, expected_seconds: int = 3600, timeline: Timeline = Timeline()
) -> DataFrame:
    """Steps longer than three expected intervals per station, and the longest step."""
    steps = timeline.select(
        df, lambda f: {"_step": _seconds_since_previous(f, timeline.order)}, before=1, keep=["station"]
    )
    return steps.groupBy("station").agg(
        F.count_if(F.col("_step") > GAP_FACTOR * expected_seconds).alias("gaps"),
        F.max("_step").alias("longest_step_seconds"),
    )


def _seconds_since_previous(f: Frame, order: str) -> Column:
    at = F.col(order).cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", F.lag(at).over(f.ordered), at)


def out_of_order(df: DataFrame, arrival: str, timestamp: str = "date") -> DataFrame:
    """Readings per station that are earlier than the reading that arrived before them."""
    arrivals = Timeline(("station",), arrival, (), None)
    back = arrivals.select(
        df,
        lambda f: {"_back": F.col(timestamp) < F.lag(timestamp).over(f.ordered)},
        before=1,
        keep=["station"],
    )
    return back.groupBy("station").agg(
        F.count_if("_back").alias("out_of_order"),
        (F.count_if("_back") == 0).cast("int").alias("monotonic"),
    )


def extraction_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, span, duplicate dates and per-column nulls and extremes (long form)."""
    per_date = df.groupBy("station", "date").agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.struct(
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.min(c).alias("lo"),
                F.max(c).alias("hi"),
                F.sum(c).alias("sum"),
                F.count(c).alias("known"),
            ).alias(c)
            for c in columns
        ],
    )
    wide = per_date.groupBy("station").agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *[
            F.struct(
                F.sum(f"{c}.nulls").alias("nulls"),
                F.min(f"{c}.lo").alias("lo"),
                F.max(f"{c}.hi").alias("hi"),
                (F.sum(f"{c}.sum") / F.sum(f"{c}.known")).alias("mean"),
            ).alias(c)
            for c in columns
        ],
    )
    ids = ["station", "rows", "duplicate_dates", "first_date", "last_date"]
    return wide.unpivot(ids, list(columns), "variable", "s").select(
        *ids,
        "variable",
        F.col("s.nulls").alias("nulls"),
        F.round("s.lo", 2).alias("min"),
        F.round("s.hi", 2).alias("max"),
        F.round("s.mean", 2).alias("mean"),
    )
