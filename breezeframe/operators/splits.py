"""Train / validation / test splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.timeline import Timeline

# --- Fixed values: default shares and gap of the positional split -----------
TEST_SHARE, VAL_SHARE, GAP_ROWS = 0.15, 0.10, 24
# --- Fixed values: last training and last validation day --------------------
TRAIN_END, VAL_END = "2023-12-31", "2024-12-31"


def calendar_split(date: Column, train_end: str = TRAIN_END, val_end: str = VAL_END) -> Column:
    return (
        F.when(date <= F.lit(train_end).cast("date"), "train")
        .when(date <= F.lit(val_end).cast("date"), "val")
        .otherwise("test")
    )


def gap_split(
    df: DataFrame,
    test: float = TEST_SHARE,
    val: float = VAL_SHARE,
    gap: int = GAP_ROWS,
    timeline: Timeline = Timeline(),
) -> DataFrame:
    """Label rows by position per station; gap rows are dropped, too short a station is an error.

    The dates at the cuts are found by rank in bucket counts, and rows are labelled by their date where they
    are: the data is neither sorted nor shuffled. Rows of one date are on one side of a cut, so dates
    should be unique per station. Rows without a date come first.
    """

    def cuts(n: Column) -> dict[str, Column]:
        test_start = n - F.floor(n * F.lit(test))
        val_end = test_start - gap
        val_start = val_end - F.floor(n * F.lit(val))
        return {"_train_end": val_start - gap, "_val_start": val_start, "_val_end": val_end, "_test_start": test_start}

    found = timeline.at_positions(df, cuts)
    found = found.withColumnsRenamed({c: f"_of_{c}" for c in timeline.key})
    same = reduce(lambda a, c: a & df[c].eqNullSafe(F.col(f"_of_{c}")), timeline.key, F.lit(True))
    too_short = F.raise_error(
        F.concat(F.lit("station too short for this split: "), F.coalesce(F.col(timeline.key[0]).cast("string"), F.lit("null")))
    ).cast("string")
    at = F.col(timeline.order)
    # A cut beyond the last row has no date: all rows are before it. A missing date is before every cut.
    before = lambda cut: at.isNull() | F.col(cut).isNull() | (at < F.col(cut))
    label = (
        F.when(cuts(F.col("_total"))["_train_end"] <= 0, too_short)
        .when(before("_train_end"), "train")
        .when(~before("_val_start") & before("_val_end"), "val")
        .when(~before("_test_start"), "test")
    )
    labelled = df.join(found, same).withColumn("split", label)
    return labelled.where(F.col("split").isNotNull()).select(*df.columns, "split")


def shared_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("station", "date")) -> DataFrame:
    """Number of rows of ``left`` whose key also occurs in ``right`` (0 for disjoint splits)."""
    return left.join(right, list(keys), "left_semi").agg(F.count(F.lit(1)).alias("shared"))


def split_counts(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("station")
        .pivot("split", ["train", "val", "test"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["train", "val", "test"])
    )
