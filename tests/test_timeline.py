from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from breezeframe.core.timeline import Timeline

from .frames import IRREGULAR, START, irregular, to_spark


@pytest.mark.parametrize(("rows", "grain"), [(10, "DAY"), (64, "HOUR"), (50_000, None)])
def test_segments_equal_plain_windows(spark, rows, grain):
    df = to_spark(spark, irregular(), IRREGULAR)
    got = Timeline(rows=rows, grain=grain).select(
        df,
        lambda f: {
            "pos": f.position(),
            "lag": F.lag("y", 40).over(f.ordered),
            "mean": F.round(F.avg("x").over(f.rows(-30, -1)), 9),
            "centred": F.round(F.avg("y").over(f.rows(-5, 5)), 9),
            "known": f.last_known("x"),
            "known_at": f.last_known_at("x", "date"),
            "ahead": f.next_known("x"),
        },
        before=40,
        after=5,
        carry=["x"],
    )
    w = W.partitionBy("station").orderBy("date")
    past = w.rowsBetween(W.unboundedPreceding, 0)
    expected = df.select(
        "*",
        (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
        F.lag("y", 40).over(w).alias("lag"),
        F.round(F.avg("x").over(w.rowsBetween(-30, -1)), 9).alias("mean"),
        F.round(F.avg("y").over(w.rowsBetween(-5, 5)), 9).alias("centred"),
        F.last("x", True).over(past).alias("known"),
        F.last(F.when(F.col("x").isNotNull(), F.col("date")), True).over(past).alias("known_at"),
        F.first("x", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("ahead"),
    )
    got = got.select(expected.columns)
    assert got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0


def test_dense_station_is_cut_by_a_finer_grain(spark):
    """All rows of one station on one day: the day bucket alone would keep them together."""
    rows = [("hot", START + dt.timedelta(seconds=20 * i), float(i), 1.0) for i in range(4_000)]
    df = spark.createDataFrame(rows, IRREGULAR)
    tagged = Timeline(rows=200).segments(df, before=30)
    largest = tagged.groupBy("station", "_seg").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 200 + 30 + 180
    lagged = Timeline(rows=200).select(df, lambda f: {"l": F.lag("x", 30).over(f.ordered)}, before=30)
    assert lagged.where("l <> x - 30").count() == 0
    assert lagged.where("l IS NULL").count() == 30


def test_null_keys_and_dates_are_kept(spark):
    rows = [(None, START, 1.0, 1.0), ("a", None, 2.0, 1.0), ("a", START, 3.0, 1.0)]
    df = spark.createDataFrame(rows, IRREGULAR)
    assert Timeline().number(df).count() == 3


def test_numeric_axis(spark):
    df = spark.range(5_000).select(F.lit("a").alias("station"), F.col("id").alias("n"))
    out = Timeline(order="n", rows=100).select(df, lambda f: {"p": F.lag("n").over(f.ordered)}, before=1)
    assert out.where("p <> n - 1").count() == 0
    assert out.where("p IS NULL").count() == 1


def test_readings_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "readings")
    to_spark(spark, irregular(), IRREGULAR).write.parquet(path)
    df = spark.read.parquet(path)
    out = Timeline().select(df, lambda f: {"l": F.lag("y").over(f.ordered)}, before=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan


def test_only_the_dense_stretch_is_refined(spark):
    """A dense station is counted by finer units, the others keep their coarse buckets; no table grows with the readings."""
    dense = [("hot", START + dt.timedelta(milliseconds=37 * i), float(i), 1.0) for i in range(30_000)]
    sparse = [(f"s{k}", START + dt.timedelta(days=5 * i), float(i), 1.0) for k in range(4) for i in range(60)]
    df = spark.createDataFrame(dense + sparse, IRREGULAR)
    tl = Timeline(rows=300)
    leaves = tl.leaves(df, ["x"])
    sizes = leaves.table.groupBy("station").agg(F.count("*").alias("n"), F.max("_n").alias("largest"), F.max("_depth").alias("depth")).collect()
    by = {r["station"]: r for r in sizes}
    assert all(by[f"s{k}"]["n"] == 60 and by[f"s{k}"]["depth"] == 0 for k in range(4))
    assert by["hot"]["largest"] <= 300 and by["hot"]["n"] < 1_200
    got = tl.select(df, lambda f: {"pos": f.position(), "l": F.lag("x", 5).over(f.ordered), "a": F.lead("x", 3).over(f.ordered)}, before=5, after=3)
    assert got.count() == df.count()
    assert got.where("pos <> x").count() == 0
    assert got.where("l <> x - 5 OR (l IS NULL) <> (x < 5)").count() == 0
    assert got.where("a <> x + 3").count() == 0 and got.where("a IS NULL").count() == 3 * 5


def test_an_over_full_moment_is_split(spark):
    """More rows at one moment than a segment holds: cut by hash, in one consistent order; equal rows warn."""
    rows = [("a", START, float(i), 1.0) for i in range(2_000)] + [("a", START + dt.timedelta(hours=k), None, 2.0) for k in (-1, 1)]
    df = spark.createDataFrame(rows, IRREGULAR)
    tl = Timeline(rows=50)
    got = tl.select(df, lambda f: {"pos": f.position(), "l": F.lag("x").over(f.ordered), "prev": f.last_known("y", strict=True)}, before=1, carry=["y"])
    assert sorted(r["pos"] for r in got.select("pos").collect()) == list(range(2_002))
    assert got.where("l IS NOT NULL").select("l").distinct().count() == 2_000
    assert tl.leaves(df).table.agg(F.max("_n")).first()[0] <= 50
    with pytest.warns(UserWarning, match="deduplicate"):
        assert Timeline(rows=5).number(spark.createDataFrame([("a", START, 1.0, 1.0)] * 40, IRREGULAR)).count() == 40


def test_sparse_numbers_make_few_buckets(spark):
    """An irregular axis: random 62-bit arrivals, a dense run, doubles and negative numbers."""
    ids = spark.range(20_000).select(F.lit("a").alias("station"), F.abs(F.xxhash64("id")).alias("n"), F.lit(1.0).alias("x"))
    run = spark.range(5_000).select(F.lit("b").alias("station"), (F.col("id") - 2_500).alias("n"), F.lit(1.0).alias("x"))
    df = ids.unionByName(run)
    w = W.partitionBy("station").orderBy("n")
    for kind in ("bigint", "double"):
        typed = df.withColumn("n", F.col("n").cast(kind))
        tl = Timeline(order="n", rows=1_000)
        assert tl.leaves(typed).table.count() < 2_500
        got = tl.select(typed, lambda f: {"p": F.lag("n").over(f.ordered), "pos": f.position()}, before=1)
        want = typed.select("*", F.lag("n").over(w).alias("p"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"))
        assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_values_at_positions(spark):
    df = to_spark(spark, irregular(), IRREGULAR)
    got = Timeline(rows=15).at_positions(df, lambda n: {"first": n * 0, "middle": F.floor(n / 2), "last": n - 1, "none": n}).collect()
    dates = {}
    for r in df.select("station", "date").collect():
        dates.setdefault(r["station"], []).append(r["date"])
    for r in got:
        own = sorted(dates[r["station"]])
        assert (r["_total"], r["first"], r["middle"], r["last"], r["none"]) == (len(own), own[0], own[len(own) // 2], own[-1], None)
