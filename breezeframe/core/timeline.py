"""Ordered windows over station series without putting a whole station in one task.

``Window.partitionBy("station")`` sends every row of a station to one task, which fails as soon as one
station holds a large share of the data.  A :class:`Timeline` cuts each station into *segments* instead:

1. count rows per (station, calendar bucket); only buckets with more than ``rows`` rows are counted
   again by the next finer unit, so a dense stretch does not refine the other stations or years;
2. prefix-sum the counts, coarse buckets per station and finer ones inside their coarse bucket, which
   gives the exact position of every bucket's first row in its station;
3. close a segment whenever ``rows`` positions have been passed;
4. send each bucket to its own segment and, as context, to every later (earlier) segment that looks
   back (ahead) far enough to need it;
5. run the window per (station, segment) and drop the context rows.

Looking back a bounded number of rows needs only context rows.  Unbounded fills use *carries*: the last
known value before, and the first known value after, each bucket, computed on the bucket tables.  Either
way the readings are shuffled once, by (station, segment).

No window partition of the bucket tables grows with the readings: the coarse one has a row per occupied
calendar unit (``COARSE * 16`` on numeric axes) of a station, the finer ones at most 1,000, the last at
most ``PARTS`` per value of ``tie``.

Each level counted is one job over the key columns when the window is set up.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

DEFAULT_SEGMENT_ROWS = 50_000
DATE_GRAINS = ("YEAR", "MONTH", "DAY")
TIME_GRAINS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND")
#: Rows of one order value are a bucket; if they are too many, they are dealt to parts by their hash.
EXACT, SPLIT = "EXACT", "SPLIT"
PARTS = 1024
#: Numeric axes start with about this many buckets a key, or fewer for short series; each level is 16 times finer.
COARSE = 4096


@dataclass(frozen=True)
class Timeline:
    """How rows are ordered and cut.

    ``grain`` is the bucket width to start with: a calendar unit, or a number for numeric axes, which
    otherwise start with a width taken from the spans and counts of the keys.

    Rows with equal ``order`` share a bucket.  If they are more than ``rows``, they are ordered by ``tie`` and
    then by a hash of the row, and cut there.  More than ``rows`` rows in one part of that (they are
    mostly equal rows) stay together, with a warning: deduplicate first.
    """

    key: tuple[str, ...] = ("station",)
    order: str = "date"
    tie: tuple[str, ...] = ()
    grain: str | int | None = None
    rows: int = DEFAULT_SEGMENT_ROWS

    def grains(self, df: DataFrame) -> list[str | int]:
        """Bucket widths from the starting one to the finest: units, or how often 16 times finer than the first."""
        kind = df.schema[self.order].dataType
        if isinstance(kind, T.DateType):
            return [*DATE_GRAINS[DATE_GRAINS.index(self.grain or "MONTH") :], SPLIT]
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return [*TIME_GRAINS[TIME_GRAINS.index(self.grain or "DAY") :], EXACT, SPLIT]
        if isinstance(kind, T.IntegralType):
            return [*range(16), SPLIT]
        return [*range(10), EXACT, SPLIT]

    def widths(self, df: DataFrame) -> DataFrame | None:
        """On numeric axes without ``grain`` the power of 16 that gives each key its number of coarse buckets."""
        if self.grain or not isinstance(df.schema[self.order].dataType, T.NumericType):
            return None
        at = F.col(self.order).cast("double")
        spans = df.groupBy(*self.key).agg((F.max(at) - F.min(at)).alias("_span"), F.count(at).alias("_n"))
        wanted = F.least(F.lit(COARSE), 4 * F.ceil(F.col("_n") / self.rows))
        power = F.floor(F.log(16.0, F.greatest(F.col("_span") / wanted, F.lit(1e-9))))
        return materialise(spans.select(*self.key, F.coalesce(power, F.lit(0)).cast("int").alias("_power")), "widths")

    def _widened(self, df: DataFrame, widths: DataFrame | None) -> DataFrame:
        if widths is None:
            return df.withColumn("_power", F.lit(math.floor(math.log(self.grain, 16)) if isinstance(self.grain, (int, float)) else 0))
        return _null_safe_join(df, widths, list(self.key), "left")

    def bucket(self, df: DataFrame, grain: str | int) -> Column:
        kind, at = df.schema[self.order].dataType, F.col(self.order)
        if isinstance(kind, T.DateType):
            return at if grain in ("DAY", SPLIT) else F.trunc(self.order, str(grain))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return at.cast("timestamp") if grain in (EXACT, SPLIT) else F.date_trunc(str(grain), self.order)
        if isinstance(kind, T.IntegralType):
            at, bits = at.cast("bigint"), 4 * F.least(F.greatest(F.col("_power") - (16 if grain == SPLIT else grain), F.lit(0)), F.lit(15))
            return F.call_function("shiftleft", F.call_function("shiftright", at, bits), bits)
        at, width = at.cast("double"), F.pow(F.lit(16.0), F.col("_power") - (0 if isinstance(grain, str) else grain))
        return at if grain in (EXACT, SPLIT) else F.floor(at / width) * width

    def part(self, df: DataFrame) -> Column:
        """Where a row stands among rows of its order value."""
        hashed = [F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString() and f.name not in ("_bucket", "_parent", "_power")]
        return F.struct(*self.tie, F.pmod(F.xxhash64(*hashed), F.lit(PARTS)).alias("_hash"))

    def _level(self, rows: DataFrame, grain: str | int, carry: Sequence[str], parents: DataFrame | None) -> DataFrame:
        """One row per (key, bucket): size, position of the first row, station total and carries.

        With ``parents``, the over-full buckets of the level above, ``rows`` are theirs and have a ``_parent``.
        """
        aggs = [F.count(F.lit(1)).alias("_n")]
        for c in carry:
            at = F.when(F.col(c).isNotNull(), F.col(self.order))
            aggs += [
                F.max_by(c, at).alias(f"_last_{c}"),
                F.max(at).alias(f"_last_at_{c}"),
                F.min_by(c, at).alias(f"_first_{c}"),
                F.min(at).alias(f"_first_at_{c}"),
            ]
        by = [self.bucket(rows, grain).alias("_bucket"), *([self.part(rows).alias("_part")] if grain == SPLIT else [])]
        above = [] if parents is None else ["_parent"]
        table = rows.groupBy(*self.key, *above, *by).agg(*aggs)
        places = ["_bucket", *(["_part"] if grain == SPLIT else [])]
        inside = Window.partitionBy(*self.key, *above)
        before = inside.orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
        # Looking ahead runs over the reversed order: a growing frame costs one step per row, a frame
        # that ends at the last row is evaluated anew for every row.
        after = inside.orderBy(*map(F.desc, places)).rowsBetween(Window.unboundedPreceding, -1)
        cols = {"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(inside)}
        for c in carry:
            for at in ("", "at_"):
                cols[f"_prev_{at}{c}"] = F.last(f"_last_{at}{c}", True).over(before)
                cols[f"_next_{at}{c}"] = F.last(f"_first_{at}{c}", True).over(after)
        drop = [f"_{p}_{c}" for c in carry for p in ("last", "last_at", "first", "first_at")]
        table = table.withColumns(cols).drop(*drop)
        if parents is None:
            return table
        handed = ["_start", "_total", *(f"_{p}_{c}" for c in carry for p in ("prev", "prev_at", "next", "next_at"))]
        told = parents.select(*self.key, F.col("_bucket").alias("_parent"), *(F.col(c).alias(f"_of{c}") for c in handed))
        joined = _null_safe_join(table, told, [*self.key, "_parent"])
        cols = {c: F.coalesce(F.col(c), F.col(f"_of{c}")) for c in handed}
        cols |= {"_start": F.col("_start") + F.col("_of_start"), "_total": F.col("_of_total")}
        return joined.withColumns(cols).drop("_parent", *(f"_of{c}" for c in handed))

    def leaves(self, df: DataFrame, carry: Sequence[str] = ()) -> Leaves:
        """The buckets that are not refined further, of every level that is needed."""
        grains, widths = self.grains(df), self.widths(df)
        df = self._widened(df, widths)
        kept: list[DataFrame] = []
        over: list[DataFrame] = []
        for depth, grain in enumerate(grains):
            rows = df
            if over:
                full = over[-1].select(*self.key, F.col("_bucket").alias("_parent"))
                rows = _null_safe_join(df.withColumn("_parent", self.bucket(df, grains[depth - 1])), full, [*self.key, "_parent"])
            sizes = Observation()
            table = self._level(rows, grain, carry, over[-1] if over else None)
            table = materialise(table.observe(sizes, F.max("_n").alias("largest")), "buckets").withColumn("_depth", F.lit(depth))
            largest = sizes.get["largest"] or 0
            if largest <= self.rows or grain == SPLIT:
                kept.append(table)
                break
            kept.append(table.where(F.col("_n") <= self.rows))
            over.append(table.where(F.col("_n") > self.rows))
        if largest > self.rows:
            warnings.warn(f"{largest} rows with one '{self.order}' cannot be cut; deduplicate first", stacklevel=2)
        table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
        table = table.withColumn("_seg", F.floor(F.col("_start") / F.lit(self.rows)))
        return Leaves(table, grains[: len(over) + 1], over, max(largest, self.rows), widths)

    def segments(
        self, df: DataFrame, before: int = 0, after: int = 0, carry: Sequence[str] = ()
    ) -> DataFrame:
        """Tag rows with their segment, adding the copies that other segments need as context."""
        leaves = self.leaves(df, carry)
        if not before and not after:
            return self.placed(df, leaves).drop("_n").withColumn("_home", F.lit(True))
        aimed = leaves._replace(table=self.plan(leaves, before, after).drop("_n"))
        return (
            self.placed(df, aimed)
            .withColumn("_target", F.explode("_targets"))
            .withColumns({"_seg": F.col("_target.seg"), "_home": F.col("_target.home")})
            .drop("_target", "_targets")
        )

    def plan(self, leaves: Leaves, before: int, after: int) -> DataFrame:
        """Add to each bucket the segments it belongs to and those it may be context for.

        Segment ``s`` starts at position ``s * rows`` or later, which bounds the later segments. The segment
        before ends where this one starts; others end less than a bucket behind the start of their next.
        """
        rows, start, seg = F.lit(self.rows), F.col("_start"), F.col("_seg")
        end = start + F.col("_n")
        mark = lambda segs, home: F.transform(segs, lambda s: F.struct(s.cast("bigint").alias("seg"), F.lit(home).alias("home")))
        none = F.array().cast("array<bigint>")
        span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo.cast("bigint"), hi.cast("bigint"))).otherwise(none)
        table, targets = leaves.table, [mark(F.array(seg), True)]
        if before:
            targets.append(mark(span(F.greatest(seg + 1, F.floor(end / rows)), F.floor((end + before - 1) / rows)), False))
        if after:
            table = table.withColumn("_lo", F.min("_start").over(Window.partitionBy(*self.key, "_seg")))
            reach = -(-leaves.largest // self.rows)
            near = F.when(start - F.col("_lo") < after, span(F.greatest(seg - reach, F.lit(0)), seg - 1)).otherwise(none)
            far = span(F.greatest(F.floor((start - after - leaves.largest) / rows), F.lit(0)), seg - 1 - reach)
            targets.append(mark(F.concat(near, far), False))
        return table.withColumn("_targets", F.concat(*targets)).drop("_lo", "_seg")

    def placed(self, df: DataFrame, leaves: Leaves) -> DataFrame:
        """Every row with the columns of its bucket."""
        # No broadcast hint: bucket tables have a known size, so the planner broadcasts them only below
        # the session threshold. Null-safe equality keeps rows with null keys.
        df = self._widened(df, leaves.widths)
        left, depth = df, F.lit(0)
        for k, full in enumerate(leaves.over):
            marks = full.select(*self.key, F.col("_bucket").alias("_parent"), F.lit(1).alias(f"_full{k}"))
            left = _null_safe_join(left.withColumn("_parent", self.bucket(df, leaves.grains[k])), marks, [*self.key, "_parent"], "left").drop("_parent")
            depth = depth + F.coalesce(F.col(f"_full{k}"), F.lit(0))
        bucket = self.bucket(df, leaves.grains[-1])
        for k in range(len(leaves.over) - 1, -1, -1):
            bucket = F.when(depth == k, self.bucket(df, leaves.grains[k])).otherwise(bucket)
        on = [*self.key, "_depth", "_bucket"]
        left = left.withColumns({"_depth": depth, "_bucket": bucket})
        if leaves.grains[-1] == SPLIT:
            last = F.col("_depth") == len(leaves.over)
            left, on = left.withColumn("_part", F.when(last, self.part(df))), [*on, "_part"]
        left = left.drop("_power", *(f"_full{k}" for k in range(len(leaves.over))))
        return _null_safe_join(left, leaves.table, on)

    def at_positions(self, df: DataFrame, positions: Callable[[Column], dict[str, Column]]) -> DataFrame:
        """Per key the order values at 0-based positions, which are given from its row count; null outside.

        Only rows of the buckets that hold a wanted position are ordered; the others are counted only.
        """
        leaves = self.leaves(df)
        wanted = positions(F.col("_total"))
        inside = [F.when((p >= F.col("_start")) & (p < F.col("_start") + F.col("_n")), p) for p in wanted.values()]
        table = leaves.table.withColumns({f"_at_{name}": p for name, p in zip(wanted, inside, strict=True)})
        some = table.where(F.coalesce(*(f"_at_{name}" for name in wanted)).isNotNull())
        hit = self.placed(df, leaves._replace(table=some))
        part = ["_part"] if leaves.grains[-1] == SPLIT else []
        by = Window.partitionBy(*self.key, "_depth", "_bucket", *part).orderBy(self.order, *self.tie)
        hit = hit.withColumn("_pos", F.col("_start") + F.row_number().over(by) - 1)
        found = hit.groupBy(*self.key).agg(
            *(F.max(F.when(F.col("_pos") == F.col(f"_at_{name}"), F.col(self.order))).alias(name) for name in wanted)
        )
        totals = leaves.table.groupBy(*self.key).agg(F.max("_total").alias("_total"))
        return materialise(_null_safe_join(totals, found, list(self.key), "left"), "positions")

    def window(self, *, backwards: bool = False, parts: bool = False) -> WindowSpec:
        by = [F.desc(c) if backwards else F.asc(c) for c in (self.order, *self.tie, *(["_part"] if parts else []))]
        return Window.partitionBy(*self.key, "_seg").orderBy(*by)

    def select(
        self,
        df: DataFrame,
        build: Callable[[Frame], dict[str, Column]],
        *,
        before: int = 0,
        after: int = 0,
        carry: Sequence[str] = (),
        keep: Sequence[str] | None = None,
        rows_as: str | None = None,
        segment_as: str | None = None,
    ) -> DataFrame:
        """``df`` plus the window columns that ``build`` describes, each row exactly once.

        ``rows_as`` makes the row position available to ``build`` as a column, ``segment_as`` keeps the
        segment number in the result.
        """
        tagged = self.segments(df, before, after, carry)
        parts = "_part" in tagged.columns
        frame = Frame(self.window(parts=parts), self.window(backwards=True, parts=parts))
        if rows_as:
            tagged = tagged.withColumn(rows_as, frame.position())
        added = build(frame)
        if segment_as:
            added = {**added, segment_as: F.col("_seg")}
        kept = [c for c in (df.columns if keep is None else keep) if c not in added]
        wide = tagged.select(*kept, "_home", *[c.alias(n) for n, c in added.items()])
        return wide.where("_home").drop("_home")

    def number(self, df: DataFrame, pos: str = "_pos", total: str | None = None) -> DataFrame:
        """Add the 0-based row position within the key, and optionally the key's row count."""
        return self.select(
            df, lambda f: {pos: f.position(), **({total: F.col("_total")} if total else {})}
        )

    def with_rows(self, rows: int) -> Timeline:
        return replace(self, rows=rows)


class Leaves(NamedTuple):
    """Buckets of all levels, the levels' grains, the over-full buckets of all but the last, and the most rows of a bucket."""

    table: DataFrame
    grains: list[str | int]
    over: list[DataFrame]
    largest: int
    widths: DataFrame | None


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that matches null with null and keeps ``left``'s key columns."""
    right = right.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = reduce(lambda a, c: a & left[c].eqNullSafe(right[f"_k_{c}"]), on, F.lit(True))
    return left.join(right, cond, how).drop(*[f"_k_{c}" for c in on])


@dataclass(frozen=True)
class Frame:
    """The window handed to ``Timeline.select`` callbacks."""

    ordered: WindowSpec
    backwards: WindowSpec

    def rows(self, lo: int, hi: int) -> WindowSpec:
        return self.ordered.rowsBetween(lo, hi)

    def position(self) -> Column:
        """0-based row position in the whole series (the first copy in a segment opens a bucket)."""
        first = F.first("_start").over(self.rows(Window.unboundedPreceding, Window.currentRow))
        return (first + F.row_number().over(self.ordered) - 1).cast("bigint")

    def last_known(self, c: str, *, strict: bool = False) -> Column:
        """Last non-null value at or before (``strict``: before) this row, over the whole series."""
        w = self.rows(Window.unboundedPreceding, -1 if strict else 0)
        return F.coalesce(F.last(c, True).over(w), F.col(f"_prev_{c}"))

    def last_known_at(self, c: str, order: str, *, strict: bool = False) -> Column:
        w = self.rows(Window.unboundedPreceding, -1 if strict else 0)
        at = F.when(F.col(c).isNotNull(), F.col(order))
        return F.coalesce(F.last(at, True).over(w), F.col(f"_prev_at_{c}"))

    def next_known(self, c: str) -> Column:
        """First non-null value at or after this row, over the whole series."""
        w = self.backwards.rowsBetween(Window.unboundedPreceding, 0)
        return F.coalesce(F.last(c, True).over(w), F.col(f"_next_{c}"))

    def next_known_at(self, c: str, order: str) -> Column:
        w = self.backwards.rowsBetween(Window.unboundedPreceding, 0)
        at = F.when(F.col(c).isNotNull(), F.col(order))
        return F.coalesce(F.last(at, True).over(w), F.col(f"_next_at_{c}"))
