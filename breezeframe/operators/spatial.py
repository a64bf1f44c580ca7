"""Inverse-distance blending of anchor stations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.shared import materialise


#: Anchors of a block; every target meets every block once, so no task needs all anchors.
BLOCK = 256


def station_weights(targets: DataFrame, anchors: DataFrame, target: str = "target", block: int = BLOCK) -> DataFrame:
    """Normalised 1/d^2 weights per target and anchor; a target on an anchor takes it alone.

    Anchors are dealt by hash to numbered blocks, targets are copied to all block numbers, and the two meet by
    block. The sums of 1/d^2 and the exact hits of a target are added from its pairs and joined back.
    """
    blocks = -(-anchors.count() // block) or 1
    dealt = anchors.select(F.col("station").alias("_station"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_station", "_lat", "_lon"), F.lit(blocks)))
    asking = targets.select(target, "lat", "lon").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    d2 = (F.col("lat") - F.col("_lat")) * (F.col("lat") - F.col("_lat")) + (F.col("lon") - F.col("_lon")) * (F.col("lon") - F.col("_lon"))
    pairs = asking.join(dealt, "_block").select(target, "lat", "lon", F.col("_station").alias("station"), d2.alias("_d2"))
    pairs = materialise(pairs, "anchor-pairs")
    away = F.when(F.col("_d2") > 0.0, 1.0 / F.nullif("_d2", F.lit(0.0)))
    place = [target, "lat", "lon"]
    sums = pairs.groupBy(*place).agg(F.count_if(F.col("_d2") == 0.0).alias("_hits"), F.sum(away).alias("_sum"))
    sums = materialise(sums, "anchor-sums")
    both = pairs.join(sums, place)
    hit = (F.col("_d2") == 0.0).cast("double") / F.nullif("_hits", F.lit(0))
    weight = F.when(F.col("_hits") > 0, hit).otherwise(away / F.col("_sum"))
    return both.select(target, "station", weight.alias("weight"))


#: Anchors side by side in a row; a target and a moment meet once for each such set of anchors.
SLOTS = 8


def _slots(stations: DataFrame, slots: int) -> DataFrame:
    """``station, _set, _at`` of distinct stations: sets of at most ``slots``, dealt by hash and numbered inside the deal."""
    groups = -(-stations.count() // slots) or 1
    dealt = stations.withColumn("_g", F.pmod(F.xxhash64("station"), F.lit(groups)))
    number = F.row_number().over(Window.partitionBy("_g").orderBy("station")) - 1
    return dealt.withColumn("_n", number).select(
        "station",
        F.struct("_g", F.floor(F.col("_n") / slots).alias("_k")).alias("_set"),
        F.pmod("_n", F.lit(slots)).alias("_at"),
    )


def blend(
    weights: DataFrame,
    readings: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("date",),
    target: str = "target",
    slots: int = SLOTS,
) -> DataFrame:
    """Weighted mean of the anchors' columns per target; anchors without a value drop out.

    The weights of a target and the readings of a moment are laid side by side for each set of anchors, so the rows of
    the result are not multiplied by the anchors, and are only shuffled if there are several sets.
    """
    spark = weights.sparkSession
    used = materialise(weights.where(F.col("weight") > 0), "weights")
    placed = materialise(_slots(used.select("station").where("station is not null").distinct(), slots), "slots")
    sets = placed.select("_set").distinct().count()

    def at(i: int, value: Column) -> Column:
        return F.when(F.col("_at") == i, value)

    asking = used.join(placed, "station").groupBy(target, "_set").agg(
        *[F.sum(at(i, F.col("weight"))).alias(f"_w{i}") for i in range(slots)]
    )
    sums = [F.sum(at(i, F.col(c))).alias(f"_s{i}_{k}") for i in range(slots) for k, c in enumerate(columns)]
    counts = [F.count(at(i, F.col(c))).alias(f"_n{i}_{k}") for i in range(slots) for k, c in enumerate(columns)]
    rows = [F.count(at(i, F.lit(1))).alias(f"_r{i}") for i in range(slots)]
    held = materialise(readings.join(placed, "station").groupBy(*by, "_set").agg(*rows, *sums, *counts), "blend-readings")
    if sets > 1:
        met = asking.join(held, "_set")
    else:
        asking = asking.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), target)
        met = materialise(asking, "blend-weights").drop("_set").crossJoin(held.drop("_set"))
    met = met.where(reduce(or_, [F.col(f"_w{i}").isNotNull() & (F.col(f"_r{i}") > 0) for i in range(slots)]))

    def total(kind: str, k: int) -> Column:
        return reduce(add, [F.coalesce(F.col(f"_w{i}") * F.col(f"_{kind}{i}_{k}"), F.lit(0.0)) for i in range(slots)])

    parts = met.select(target, *by, *[total(kind, k).alias(f"_{kind}_{k}") for k in range(len(columns)) for kind in "sn"])
    if sets > 1:
        parts = parts.groupBy(target, *by).agg(*[F.sum(f"_{kind}_{k}").alias(f"_{kind}_{k}") for k in range(len(columns)) for kind in "sn"])
    return parts.select(target, *by, *[(F.col(f"_s_{k}") / F.nullif(f"_n_{k}", F.lit(0.0))).alias(c) for k, c in enumerate(columns)])


def blended_monthly_pattern(
    weights: DataFrame, readings: DataFrame, columns: Sequence[str], places: int = 1
) -> DataFrame:
    """Monthly means per anchor, then blended per target."""
    monthly = readings.groupBy("station", F.month("date").alias("month")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )
    out = blend(weights, monthly, columns, by=("month",))
    return out.withColumns({c: F.round(c, places) for c in columns})
