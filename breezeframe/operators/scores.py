"""Regression scores, residuals, rankings and the two naive forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.shared import materialise

# --- Fixed values: guards and binning ---------------------------------------
EPSILON = 1e-8
HISTOGRAM_BINS = 55
SCORES = ("rmse", "mae", "mape", "smape", "r2")


def persistence(df: DataFrame, lag: int = 1) -> DataFrame:
    """The value ``lag`` rows ago as prediction; rows without one are left out."""
    name = f"lag_aqi_{lag}"
    return df.where(F.col(name).isNotNull()).withColumn("prediction", F.col(name))


def seasonal_mean(df: DataFrame, train: DataFrame, column: str = "aqi") -> DataFrame:
    """Training mean of the same month as prediction."""
    means = train.groupBy(F.month("date").alias("_month")).agg(F.avg(column).alias("prediction"))
    means = materialise(means, "monthly")
    return df.join(means, F.month(df["date"]) == means["_month"], "left").drop("_month")


def regression_scores(
    df: DataFrame,
    by: Sequence[str] = ("model", "split"),
    actual: str = "aqi",
    predicted: str = "prediction",
    station: str | None = "station",
) -> DataFrame:
    """RMSE, MAE, MAPE, sMAPE and R2 per group and, in the same pass, per group and station.

    Rows for all stations together carry the station name ``Combined``.
    """
    y, p = F.col(actual), F.col(predicted)
    err = y - p
    known = df.where(y.isNotNull() & p.isNotNull())
    # Sums per (group, station) first: the grouping sets then work on a handful of rows. Squared
    # deviations are merged from per-station moments.
    parts = known.groupBy(*by, *([station] if station else [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err * err).alias("_sse"),
        F.sum(F.abs(err)).alias("_sae"),
        F.sum(F.abs(err / F.greatest(F.abs(y), F.lit(EPSILON)))).alias("_ape"),
        F.sum(F.abs(err) / ((F.abs(y) + F.abs(p)) / 2 + EPSILON)).alias("_sape"),
        F.avg(y).alias("_mean"),
        F.var_pop(y).alias("_var"),
    )
    if station:
        grouped = parts.groupingSets([[*by, station], [*by]], *by, station)
    else:
        grouped = parts.groupBy(*by)
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("_mean")) / n
    within = F.sum(F.col("n") * F.col("_var"))
    between = F.sum(F.col("n") * F.col("_mean") * F.col("_mean")) - n * mean * mean
    sst = F.when(F.count(F.lit(1)) == 1, within).otherwise(within + F.greatest(F.lit(0.0), between))
    sse = F.sum("_sse")
    scored = grouped.agg(
        n.alias("n"),
        F.sqrt(sse / n).alias("rmse"),
        (F.sum("_sae") / n).alias("mae"),
        (F.sum("_ape") * 100.0 / n).alias("mape"),
        (F.sum("_sape") * 100.0 / n).alias("smape"),
        F.when(sst <= 0.0, F.when(sse == 0.0, 1.0).otherwise(0.0))
        .otherwise(1.0 - sse / sst)
        .alias("r2"),
    )
    return scored.withColumn(station, F.coalesce(station, F.lit("Combined"))) if station else scored


def residual_summary(
    df: DataFrame, by: Sequence[str] = ("model",), actual: str = "aqi", predicted: str = "prediction"
) -> DataFrame:
    """Bias, population deviation, two-sigma limits and the monthly mean residuals."""
    r = F.col(actual) - F.col(predicted)
    sd = F.stddev_pop(r)
    months = [
        F.coalesce(F.avg(F.when(F.month("date") == m, r)), F.lit(0.0)).alias(f"m{m}")
        for m in range(1, 13)
    ]
    return df.groupBy(*by).agg(
        F.avg(r).alias("bias"),
        sd.alias("std"),
        (F.avg(r) - 2 * sd).alias("lower"),
        (F.avg(r) + 2 * sd).alias("upper"),
        *months,
    )


def residual_histogram(
    df: DataFrame,
    by: Sequence[str] = ("model",),
    actual: str = "aqi",
    predicted: str = "prediction",
    bins: int = HISTOGRAM_BINS,
) -> DataFrame:
    """Counts in equal bins between the smallest and largest residual; the top edge is inclusive."""
    rows = df.select(*by, (F.col(actual) - F.col(predicted)).alias("_r")).where(
        F.col("_r").isNotNull()
    )
    edges = rows.groupBy(*by).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    edges = materialise(edges, "edges")
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.lit(bins - 1), F.floor((F.col("_r") - F.col("_lo")) / width))
    return (
        rows.join(edges, list(by))
        .groupBy(*by, F.when(width > 0, slot).otherwise(0).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rank_models(scores: DataFrame, by: Sequence[str] = ("split", "station")) -> DataFrame:
    """Rank by RMSE ascending within each split; one row per model, so groups stay small."""
    w = Window.partitionBy(*by).orderBy("rmse", "model")
    return scores.withColumn("rank", F.row_number().over(w))


def join_result_tables(
    first: DataFrame, second: DataFrame, renames: dict[str, str], kinds: tuple[str, str] = ("ML", "DL")
) -> DataFrame:
    """Result tables of two model families under the first one's column names, best RMSE first."""
    a = first.withColumn("family", F.lit(kinds[0]))
    b = second.withColumnsRenamed(renames).withColumn("family", F.lit(kinds[1]))
    return a.unionByName(b, allowMissingColumns=True).orderBy("rmse", "model")


def overfit_gap(scores: DataFrame) -> DataFrame:
    """Training minus validation RMSE per model over all stations."""
    combined = scores.where(F.col("station") == "Combined")
    wide = combined.groupBy("model").agg(
        *[F.max(F.when(F.col("split") == s, F.col("rmse"))).alias(f"rmse_{s}") for s in ("train", "val", "test")]
    )
    return wide.withColumn("overfit_gap", F.col("rmse_train") - F.col("rmse_val"))
