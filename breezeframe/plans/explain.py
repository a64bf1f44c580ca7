"""Batch attribution of predictions: coalition regression and occlusion."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import predict_vectors

# --- Fixed values: coalition count, ridge term and end weight ---------------
COALITIONS = 256
RIDGE = 1e-6
SEED = 42
MAX_PLAN_CELLS = 2_000_000


def _size_weight(n: int, size: int) -> float:
    return (n - 1) / (comb(n, size) * size * (n - size))


def coalition_plan(n: int, coalitions: int = COALITIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Paired masks (M x n) and the projection (n x M) from centred predictions to attributions.

    The masks are shared by all rows, so the regression is solved once for every row.
    """
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, n)
    odds = np.array([_size_weight(n, int(s)) for s in sizes])
    drawn = rng.choice(sizes, size=coalitions // 2, p=odds / odds.sum())
    order = rng.random((len(drawn), n)).argsort(axis=1).argsort(axis=1)
    chosen = order < drawn[:, None]
    masks = np.stack([chosen, ~chosen], axis=1).reshape(-1, n)
    weights = np.repeat([_size_weight(n, int(s)) for s in drawn], 2)
    z = masks.astype(float)
    zw = z.T * weights
    projection = np.linalg.solve(zw @ z + RIDGE * np.eye(n), zw)
    return masks, projection


def coalition_attribution(
    model: PipelineModel,
    df: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    row: Sequence[str] = ("station", "date"),
    coalitions: int = COALITIONS,
    seed: int = SEED,
) -> DataFrame:
    """Attributions in long form; per row they sum to prediction minus base value.

    Every row meets every mask, all combinations are scored by one distributed ``transform``, and the
    regression collapses to one weighted sum per feature inside the map tasks.
    """
    n = len(features)
    masks, projection = coalition_plan(n, coalitions, seed)
    plan = df.sparkSession.createDataFrame(
        [
            (m, [float(v) for v in masks[m]], [float(v) for v in projection[:, m]])
            for m in range(len(masks))
        ],
        "m int, keep array<double>, p array<double>",
    )
    values = F.array(*[F.col(f).cast("double") for f in features])
    known = background.dropna(subset=list(features))
    centre = known.agg(F.array(*[F.avg(f) for f in features]).alias("c")).scalar()
    base = predict_vectors(model, known.select(values.alias("_v")), "_v").agg(
        F.avg("prediction").alias("b")
    ).scalar()
    rows = df.dropna(subset=list(features)).select(*row, values.alias("_x"))
    whole = predict_vectors(model, rows, "_x").withColumnRenamed("prediction", "_fx")
    # A plan is broadcast up to MAX_PLAN_CELLS numbers; a larger one is joined by shuffle.
    plan = F.broadcast(plan) if coalitions * n <= MAX_PLAN_CELLS else plan
    paired = (
        whole.withColumn("_c", centre)
        .withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))))
        .join(plan, "m")
    )
    mixed = F.transform(
        F.arrays_zip("_x", "_c", "keep"),
        lambda t: F.when(t["keep"] == 1.0, t["_x"]).otherwise(t["_c"]),
    )
    scored = predict_vectors(model, paired.withColumn("_v", mixed), "_v").withColumn(
        "_t", F.col("prediction") - base
    )
    sums = scored.groupBy(*row).agg(
        F.first("_fx").alias("_fx"),
        *[F.sum(F.col("_t") * F.col("p")[j]).alias(f"_p{j}") for j in range(n)],
    )
    raw = F.array(*[F.col(f"_p{j}") for j in range(n)])
    total = F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v)
    factor = F.when(F.abs("_sum") > 1e-8, (F.col("_fx") - F.col("_base")) / F.col("_sum")).otherwise(1.0)
    per_row = (
        sums.withColumn("_raw", raw)
        .withColumn("_sum", total)
        .withColumn("_base", base)
        .withColumn("_f", factor)
    )
    return _long(per_row, row, features, F.transform("_raw", lambda v: v * F.col("_f")))


def _long(df: DataFrame, row: Sequence[str], features: Sequence[str], phi: Column) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    return df.select(
        *row,
        F.col("_fx").alias("prediction"),
        F.col("_base").alias("base"),
        # The outer variant keeps the optimizer from evaluating the attribution once more as a filter.
        F.posexplode_outer(phi).alias("_j", "phi"),
    ).select(*row, F.get(names, F.col("_j")).alias("feature"), "phi", "prediction", "base")


def occlusion_attribution(
    model: PipelineModel,
    df: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    explained: Sequence[str],
    row: Sequence[str] = ("station", "date"),
) -> DataFrame:
    """Prediction drop when one feature is set to its background mean; the remainder is spread evenly
    over the explained features so that they sum to prediction minus base."""
    where = [list(features).index(e) for e in explained]
    values = F.array(*[F.col(f).cast("double") for f in features])
    known = background.dropna(subset=list(features))
    centre = known.agg(F.array(*[F.avg(f) for f in features]).alias("c")).scalar()
    rows = df.dropna(subset=list(features)).select(*row, values.alias("_x")).withColumn("_c", centre)
    positions = F.array(*[F.lit(i) for i in where])
    explained_to_mean = F.transform(
        "_x",
        lambda v, i: F.when(F.array_contains(positions, i), F.get("_c", i)).otherwise(v),
    )
    # -2: the row itself, -1: every explained feature at its mean, k: feature k at its mean.
    variants = rows.withColumn(
        "_k", F.explode(F.array(*[F.lit(k) for k in (-2, -1, *range(len(where)))]))
    )
    single = F.transform(
        "_x",
        lambda v, i: F.when(i == F.get(positions, F.col("_k")), F.get("_c", i)).otherwise(v),
    )
    variant = (
        F.when(F.col("_k") == -2, F.col("_x"))
        .when(F.col("_k") == -1, explained_to_mean)
        .otherwise(single)
    )
    scored = predict_vectors(model, variants.withColumn("_v", variant), "_v")

    def at(k: int) -> Column:
        return F.max(F.when(F.col("_k") == k, F.col("prediction")))

    per_row = scored.groupBy(*row).agg(
        at(-2).alias("_fx"),
        at(-1).alias("_base"),
        F.array(*[at(k) for k in range(len(where))]).alias("_o"),
    )
    drops = per_row.withColumn("_d", F.transform("_o", lambda v: F.col("_fx") - v))
    spread = (
        F.col("_fx") - F.col("_base") - F.aggregate("_d", F.lit(0.0), lambda a, v: a + v)
    ) / len(where)
    return _long(
        drops.withColumn("_e", spread), row, explained, F.transform("_d", lambda v: v + F.col("_e"))
    )
