"""Roll-ups, rankings and comparisons of attributions (long table: row, station, season, feature, phi)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values: agreement limits, report sizes and cut-offs --------------
STRONG, MODERATE = 2, 5
WATERFALL_TOP = 12
EXTRA_FEATURES, EXTRA_MIN = 3, 0.5
# Scores are compared after rounding: equal ones are then ordered by name, not by their last bits.
RANK_PLACES = 9
FIXED_FEATURES = ("pm25", "pm10", "no2", "wind_speed", "humidity", "temperature")


def _best(score: Column | str) -> Column:
    return F.desc(F.round(score, RANK_PLACES))


def roll_up(phi: DataFrame) -> DataFrame:
    """Mean absolute and mean phi per feature: overall, per station and per season, in one pass."""
    sums = phi.groupBy("feature", "station", "season").agg(
        F.sum(F.abs("phi")).alias("_a"), F.sum("phi").alias("_s"), F.count("phi").alias("_n")
    )
    sets = sums.groupingSets(
        [["feature"], ["feature", "station"], ["feature", "season"]], "feature", "station", "season"
    )
    return sets.agg(
        (F.sum("_a") / F.sum("_n")).alias("mean_abs"), (F.sum("_s") / F.sum("_n")).alias("mean_phi")
    ).select(
        "feature",
        F.when(F.col("station").isNotNull(), "station")
        .when(F.col("season").isNotNull(), "season")
        .otherwise("all")
        .alias("scope"),
        F.coalesce("station", "season", F.lit("all")).alias("member"),
        "mean_abs",
        "mean_phi",
    )


def station_contrast(rolled: DataFrame, a: str, b: str) -> DataFrame:
    """Two stations side by side: difference of mean |phi| and the dominant station."""
    per = rolled.where((F.col("scope") == "station") & F.col("member").isin(a, b))
    wide = per.groupBy("feature").agg(
        F.max(F.when(F.col("member") == a, F.col("mean_abs"))).alias("first"),
        F.max(F.when(F.col("member") == b, F.col("mean_abs"))).alias("second"),
        # Of equal means the second station's counts, as a difference of zero does not favour the first.
        F.max_by("member", F.when(F.col("mean_abs").isNotNull(), F.struct("mean_abs", F.col("member") == b))).alias("dominant"),
    )
    return wide.withColumn("difference", F.col("first") - F.col("second"))


def peak_season(rolled: DataFrame) -> DataFrame:
    per = rolled.where(F.col("scope") == "season")
    return per.groupBy("feature").agg(
        # The first by name of equal means; NaN is above all numbers, as in an ordering.
        F.min_by("member", F.when(F.col("mean_abs").isNotNull(), F.struct(F.when(F.isnan("mean_abs"), float("-inf")).otherwise(-F.col("mean_abs")), "member"))).alias("peak_season"),
        F.max("mean_abs").alias("peak_mean_abs"),
    )


def fuse(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Equal-weight mean of two min-max normalised scores with its rank; one row per feature."""
    span = scores.agg(
        F.struct(
            F.min(first).alias("lo1"),
            F.max(first).alias("hi1"),
            F.min(second).alias("lo2"),
            F.max(second).alias("hi2"),
        ).alias("s")
    ).scalar()

    def norm(c: str, i: int):
        lo, hi = F.col(f"_s.lo{i}"), F.col(f"_s.hi{i}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)

    fused = scores.withColumn("_s", span).withColumn("fused", (norm(first, 1) + norm(second, 2)) / 2)
    by_fused = Window.orderBy(_best("fused"), "feature")
    return fused.drop("_s").withColumn("rank", F.row_number().over(by_fused))


def compare_rankings(attribution: DataFrame, importance: DataFrame) -> DataFrame:
    """Attribution rank against model-importance rank per feature (one row per feature)."""
    joined = attribution.select("feature", F.col("mean_abs").alias("attribution")).join(
        importance.select("feature", "importance"), "feature", "left"
    )
    joined = joined.withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    ranked = joined.withColumns(
        {
            "attribution_rank": F.row_number().over(Window.orderBy(_best("attribution"), "feature")),
            "importance_rank": F.row_number().over(Window.orderBy(_best("importance"), "feature")),
        }
    )
    gap = F.abs(F.col("attribution_rank") - F.col("importance_rank"))
    return ranked.withColumn("rank_difference", gap).withColumn(
        "agreement",
        F.when(gap <= STRONG, "Strong").when(gap <= MODERATE, "Moderate").otherwise("Weak"),
    )


def top_features(scores: DataFrame, score: str, n: int, absolute: bool = False) -> DataFrame:
    """The ``n`` highest (or largest in absolute value) with their rank."""
    key = F.abs(score) if absolute else F.col(score)
    top = scores.withColumn("_k", F.round(key, RANK_PLACES)).orderBy(F.desc("_k"), "feature").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_k"), "feature")))
    return ranked.drop("_k")


def waterfall(phi: DataFrame, row: Sequence[str], n: int = WATERFALL_TOP) -> DataFrame:
    """Per row the ``n`` largest |phi| and the sum of the others as ``other``.

    A row has one entry per feature, so its window is as small as the feature list.
    """
    w = Window.partitionBy(*row).orderBy(_best(F.abs("phi")), "feature")
    ranked = phi.select(*row, "feature", "phi", F.row_number().over(w).alias("_rn"))
    name = F.when(F.col("_rn") <= n, F.col("feature")).otherwise("other")
    return ranked.groupBy(*row, name.alias("feature")).agg(F.sum("phi").alias("phi"))


def display_selection(
    phi: DataFrame, row: Sequence[str], fixed: Sequence[str] = FIXED_FEATURES
) -> DataFrame:
    """The fixed features, and of the others the three largest above 0.5, ordered by phi."""
    is_fixed = F.col("feature").isin(*fixed)
    w = Window.partitionBy(*row, is_fixed).orderBy(_best(F.abs("phi")), "feature")
    ranked = phi.select(*row, "feature", "phi", is_fixed.alias("_f"), F.row_number().over(w).alias("_rn"))
    kept = ranked.where(
        F.col("_f") | ((F.col("_rn") <= EXTRA_FEATURES) & (F.abs("phi") > EXTRA_MIN))
    )
    order = Window.partitionBy(*row).orderBy(_best("phi"), "feature")
    return kept.withColumn("place", F.row_number().over(order)).drop("_f", "_rn")


def mean_importance(importances: DataFrame) -> DataFrame:
    """Mean of several models' importances per feature."""
    return importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
