"""Connected components of a link table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise


def components(links: DataFrame, name: str) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``: the smallest id reachable.

    Each round maps every id to the first of its neighbours and itself, and replaces the ids of all links by
    it; links within one id vanish. The first round orders by id, so stars around their smallest id, which
    most groups of copies are, end in it. Later rounds order by a hash that differs from round to round, so
    about a quarter or more of the ids is expected to go in each, also along chains. At the end the maps of the rounds are chained.
    Every round is written to the shared folder, so lost executors cost one round and plans stay short.
    Minima are pre-aggregated; the joins behind them are plain equi-joins against a written map, which
    adaptive execution splits when one hub has most links. Null ids and self links are ignored; an empty
    table gives an empty result.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = materialise(_links(links.where(a.isNotNull() & b.isNotNull()), a, b), name)
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        step = materialise(_first_neighbours(edges, len(maps)), f"{name}-map")
        ends = (step.select(F.col("id").alias(s), F.col("component").alias(f"{s}_to")) for s in "ab")
        moved = edges.join(next(ends), "a").join(next(ends), "b")
        edges = materialise(_links(moved, F.col("a_to"), F.col("b_to")), name)
        maps.append(step)
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if len(maps) == 1:
        return maps[0]  # one round by id leaves no link, so all ids of a group went to its smallest
    found = maps.pop()
    for step in reversed(maps):
        further = materialise(found, f"{name}-map").select(F.col("id").alias("component"), F.col("component").alias("to"))
        found = step.join(further, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    found = materialise(found, f"{name}-map")
    least = materialise(found.groupBy("component").agg(F.min("id").alias("least")), f"{name}-map")
    return found.join(least, "component").select("id", F.col("least").alias("component"))


def _links(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Distinct ``(a, b)`` with ``a < b``."""
    return rows.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _first_neighbours(edges: DataFrame, number: int) -> DataFrame:
    """``id, component``: the first of an id and its neighbours, in the order of round ``number``."""
    place = lambda c: F.xxhash64(c, F.lit(number)) if number else F.col(c)
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = both.groupBy("u").agg(F.min_by("v", place("v")).alias("v"), F.min(place("v")).alias("place"))
    return near.select(F.col("u").alias("id"), F.when(F.col("place") < place("u"), F.col("v")).otherwise(F.col("u")).alias("component"))
