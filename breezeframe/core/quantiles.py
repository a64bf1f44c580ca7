"""Exact, linearly interpolated quantiles that never hold a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer.  Here a mergeable
sketch brackets each order statistic, one aggregation counts what lies below each bracket exactly and
keeps only the distinct values inside it (and the nearest value on either side), and the rank is
resolved among those few values. Both summaries are stored, so the rows are read exactly twice. The exact
counts show when a rank lies outside its bracket; then the brackets of those groups are widened to the end of
the range on that side, and only the rows of those groups are counted once more. So a result is never a guess.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

ACCURACY = 10_000
# Bracket half-width in rank fraction; three times the sketch's error bound.
MARGIN = 3.0 / ACCURACY
BINS = 4096


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: dict[str, float]
) -> DataFrame:
    """One row per group with ``n`` (non-null values) and one column per entry of ``probs``."""
    keys = list(keys)
    names = list(probs)
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, x.cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & ~F.isnan("_x")
    )
    cuts = [max(0.0, p - MARGIN) for p in probs.values()]
    cuts += [min(1.0, p + MARGIN) for p in probs.values()]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_x", cuts, F.lit(ACCURACY)).alias("_cuts"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
    )
    k = len(names)

    def low(i: int) -> Column:
        # A margin that reaches the end of the range takes the true end, not a sketched one.
        cut = F.col("_cuts")[i]
        return F.col("_min") if cuts[i] == 0.0 else cut

    def high(i: int) -> Column:
        cut = F.col("_cuts")[k + i]
        return F.col("_max") if cuts[k + i] == 1.0 else cut

    bounds = [F.struct(low(i).alias("lo"), high(i).alias("hi")) for i in range(k)]
    sketch = materialise(sketch.select(*keys, F.array(*bounds).alias("_b"), "_min", "_max"), "sketch")
    solved = materialise(_resolved(rows, sketch, keys, list(probs.values())), "solved")
    if not solved.where("_q IS NULL").isEmpty():
        sides = [F.max(F.when((F.col("_i") == i) & F.col("_q").isNull(), F.col("_side"))).alias(f"_s{i}") for i in range(k)]
        missed = materialise(solved.groupBy(*keys).agg(*sides, F.count_if(F.col("_q").isNull()).alias("_m")).where("_m > 0"), "missed")
        wider = [
            F.struct(
                F.when(F.col(f"_s{i}") < 0, F.col("_min")).otherwise(F.col("_b")[i]["lo"]).alias("lo"),
                F.when(F.col(f"_s{i}") > 0, F.col("_max")).otherwise(F.col("_b")[i]["hi"]).alias("hi"),
            )
            for i in range(k)
        ]
        second = _attach(sketch, missed, keys).select(*keys, F.array(*wider).alias("_b"))
        second = materialise(second, "second")
        rest = _anti(solved, second, keys)
        solved = rest.unionByName(_resolved(rows, second, keys, list(probs.values())))
    checked = F.when(F.col("_q").isNull(), F.raise_error(F.lit("quantile rank outside the range of its group")).cast("double"))
    return solved.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        *[F.max(F.when(F.col("_i") == i, checked.otherwise(F.col("_q")))).alias(nm) for i, nm in enumerate(names)],
    )


def _resolved(rows: DataFrame, sketch: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``keys, _i, _n, _side, _q`` for the groups of ``sketch(keys, _b)`` and every probability.

    ``_q`` is null where the bracket misses the rank, which then lies below (``_side`` -1) or above it (1).
    """
    k = len(probs)
    sketch = sketch.select(*keys, "_b")
    inside = F.lit(False)
    for i in range(k):
        inside = inside | F.col("_x").between(F.col("_b")[i]["lo"], F.col("_b")[i]["hi"])
    counted = materialise(
        _attach(rows, sketch, keys)
        .groupBy(*keys, F.when(inside, F.col("_x")).alias("_v"))
        .agg(
            F.count(F.lit(1)).alias("_c"),
            *[F.count_if(F.col("_x") < F.col("_b")[i]["lo"]).alias(f"_u{i}") for i in range(k)],
            *[
                F.max(F.when(F.col("_x") < F.col("_b")[i]["lo"], F.col("_x"))).alias(f"_before{i}")
                for i in range(k)
            ],
            *[
                F.min(F.when(F.col("_x") > F.col("_b")[i]["hi"], F.col("_x"))).alias(f"_after{i}")
                for i in range(k)
            ],
        ),
        "counted",
    )
    # Below-bracket counts arrive spread over the counted rows: fold them per group, then keep one
    # row per (group, probability, candidate value).
    per_prob = [
        F.struct(
            F.sum(f"_u{i}").alias("under"),
            F.max(f"_before{i}").alias("before"),
            F.min(f"_after{i}").alias("after"),
            F.lit(float(p)).alias("p"),
        )
        for i, p in enumerate(probs)
    ]
    folded = counted.groupBy(*keys).agg(F.array(*per_prob).alias("_w"), F.sum("_c").alias("_n"))
    spread = folded.select(*keys, "_n", F.posexplode("_w").alias("_i", "_w"))
    # The value just below the bracket holds the rank before it, so it joins the candidates.
    wanted = spread.select(
        *keys,
        "_i",
        "_n",
        (F.col("_w.under") - F.col("_w.before").isNotNull().cast("bigint")).alias("_under"),
        (F.col("_w.p") * (F.col("_n") - 1)).alias("_r"),
    )
    neighbours = F.array_compact(
        F.array(
            F.when(
                F.col("_w.before").isNotNull(),
                F.struct(F.col("_w.before").alias("v"), F.lit(-1).cast("bigint").alias("bin")),
            ),
            F.when(
                F.col("_w.after").isNotNull(),
                F.struct(F.col("_w.after").alias("v"), F.lit(BINS).cast("bigint").alias("bin")),
            ),
        )
    )
    outer = spread.select(*keys, "_i", F.explode(neighbours).alias("_e")).select(
        *keys, F.col("_e.v").alias("_v"), F.lit(1).cast("bigint").alias("_c"), "_i", F.col("_e.bin").alias("_bin")
    )
    lo, hi = F.col("_r")["lo"], F.col("_r")["hi"]
    fraction = F.when(hi > lo, (F.col("_v") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    candidates = (
        _attach(counted.where(F.col("_v").isNotNull()).select(*keys, "_v", "_c"), sketch, keys)
        .select(*keys, "_v", "_c", F.posexplode("_b").alias("_i", "_r"))
        .where(F.col("_v").between(lo, hi))
        .withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(fraction * BINS)).cast("bigint"))
        .drop("_r")
        .unionByName(outer)
    )
    group = [*keys, "_i"]
    w_bins = Window.partitionBy(*group).orderBy("_bin")
    bins = _attach(
        candidates.groupBy(*group, "_bin").agg(F.sum("_c").alias("_c")), wanted, group
    ).select(
        *group,
        "_bin",
        "_n",
        "_r",
        "_c",
        (
            F.col("_under")
            + F.coalesce(F.sum("_c").over(w_bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).alias("_from"),
    )
    hit = bins.where(
        (F.floor("_r") < F.col("_from") + F.col("_c")) & (F.ceil("_r") >= F.col("_from"))
    ).drop("_c")
    w_values = Window.partitionBy(*group, "_bin").orderBy("_v")
    placed = _attach(candidates, hit, [*group, "_bin"]).withColumn(
        "_upto", F.col("_from") + F.sum("_c").over(w_values)
    )
    lo_rank, hi_rank = F.floor("_r"), F.ceil("_r")
    covers = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
    found = placed.groupBy(*group).agg(
        F.max(F.when(covers(lo_rank), F.col("_v"))).alias("_lo"),
        F.max(F.when(covers(hi_rank), F.col("_v"))).alias("_hi"),
    )
    # A rank that no candidate covers leaves no row here, so the groups come from the counts.
    return _attach(wanted, found, group, "left").select(
        *group,
        "_n",
        F.when(lo_rank < F.col("_under"), -1).otherwise(1).alias("_side"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_r") - lo_rank)).alias("_q"),
    )


def _anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose group is not in ``right``, which is not empty."""
    known = right.select(*on, F.lit(True).alias("_known"))
    return _attach(left, known, on, "left").where("_known IS NULL").drop("_known")


def _attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join on ``on``."""
    if not on:
        # One summary row for the whole table, addressed through a constant key.
        return left.withColumn("_one", F.lit(1)).join(
            right.withColumn("_one", F.lit(1)), "_one", how
        ).drop("_one")
    renamed = right.select(
        *[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in right.columns if c not in on]
    )
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(renamed[f"_k_{c}"])
    return left.join(renamed, cond, how).drop(*[f"_k_{c}" for c in on])
