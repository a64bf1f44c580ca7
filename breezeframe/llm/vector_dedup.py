"""Near-duplicate vectors by sorted projection passes.

Equal vectors of one label are one class first, with a count, so copies are compared once however many they are.
Each pass gives a class the signs of its projections on ``BITS`` random directions of that pass, taken from the
centre of its label, and orders all classes by label and then by these bits, first to last. Partitions hold
stretches of this order; inside, every vector is compared by exact cosine with its neighbours in its own and the
next block of ``WINDOW`` vectors.

Passes run in rounds of ``passes``. A label takes part until it has had the passes that its size and its spread
around its centre ask for (``passes_needed``: a pair at the threshold is missed with a chance of ``MISS``), and
until a round joins components by at most ``NEWS`` of the links it finds; so labels whose vectors are clustered in
ways a centre does not show go on as long as passes still find news. There is no cap on rounds.

Links of all passes are united to components. Then the links inside each component are counted in full, block
against block, so vectors whose neighbours overflow a window get all their links; only counts leave a task.

Vectors that are null, empty, zero, or hold null or non-finite components, and null labels, link with
nothing; vectors of another length are compared among themselves only. Vectors keep their own precision, and
cosines are taken in double precision. Repeated ids count as rows. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

from .components import components

COSINE = 0.93
PASSES = 6
BITS = 40
WINDOW = 256
BLOCK = 2048
MISS, NEWS = 0.05, 0.02


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, scaled to length one in double precision, one length only."""
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64)
    rows = flat.reshape(len(column), -1)
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def passes_needed(n: Column, shared: Column, cosine: float) -> Column:
    """Passes after which a pair at the threshold, in a label of ``n`` vectors, is missed with a chance of ``MISS``.

    ``shared`` is the squared length of the label's mean unit vector, the cosine that its vectors have on average.
    Seen from the centre, a pair at ``cosine`` is at ``(cosine - shared) / (1 - shared)``. Its signs differ with a
    chance of that angle over pi; it shares a window when as many leading signs agree as halve ``n`` down to ``WINDOW``.
    """
    inner = F.greatest(F.lit(0.0), (F.lit(cosine) - shared) / F.greatest(F.lit(1e-9), 1 - shared))
    agree = 1 - F.acos(inner) / math.pi
    meets = F.pow(agree, F.greatest(F.lit(0.0), F.log2(n / WINDOW)))
    needed = F.ceil(F.lit(math.log(MISS)) / F.log(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), 1 - meets))))
    return F.when(shared >= cosine, F.lit(1)).otherwise(needed).cast("long")  # there, neighbours of any window link


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of each label and length in a batch."""
    for batch in batches:
        label, size = np.asarray(batch.column("label")), np.asarray(batch.column("size"))
        order = np.lexsort((size, label))
        starts = np.flatnonzero(np.r_[True, (np.diff(label[order]) != 0) | (np.diff(size[order]) != 0)]) if len(order) else []
        for at in np.split(order, starts[1:]) if len(order) else []:
            total = unit_rows(batch.column("vector").take(pa.array(at))).sum(axis=0)
            columns = [pa.array([label[at[0]]], pa.int64()), pa.array([size[at[0]]], pa.int32()), pa.array([len(at)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([total.tolist()], pa.list_(pa.float64()))], names=["label", "size", "n", "sums"])


def label_centres(classes: DataFrame, cosine: float) -> DataFrame:
    """``label, size, n, centre, needed``: mean unit vector of each label and vector length, and the passes it asks for."""
    parts = classes.select("label", "size", "vector").mapInArrow(_sums, "label long, size int, n long, sums array<double>")
    parts = parts.select("label", "size", "n", F.posexplode("sums").alias("pos", "x"))
    means = parts.groupBy("label", "size", "pos").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])  # one entry per dimension
    means = means.groupBy("label", "size").agg(F.max("n").alias("n"), centre.alias("centre"), F.sum(F.col("x") * F.col("x")).alias("shared"))
    return means.select("label", "size", "n", "centre", passes_needed(F.col("n"), F.col("shared"), cosine).alias("needed"))


def _keys(passes: int, seed: int, number: int):
    """The sort keys of round ``number``; they depend on the seed, the round and the length of a vector only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                centre = np.asarray(part.column("centre").flatten()).reshape(-1, int(size))
                from_centre = unit_rows(part.column("vector")) - centre
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, number, int(size)]).standard_normal((int(size), passes * BITS))
                bits = (from_centre @ planes[size] > 0).reshape(len(part), passes, BITS)
                keys = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, passes * len(part) + 1, passes), pa.int32()), pa.array((bits * powers).sum(axis=2).reshape(-1))
                )
                part = part.drop_columns(["centre"])
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, "keys"])

    return run


def _spanning(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id with the smallest of its connected part of a link matrix."""
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None, :], len(ids)).min(axis=1, initial=len(ids))
        new = np.minimum(new, label)[np.minimum(new, label)]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _window_links(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(block: pa.Table) -> pa.RecordBatch:
            ids, label, size = (np.asarray(block.column(c)) for c in ("class", "label", "size"))
            a, b = [], []
            for one in np.unique(size):
                at = np.flatnonzero(size == one)
                unit = unit_rows(block.column("vector").take(pa.array(at)))
                linked = (unit @ unit.T >= cosine) & (label[at][:, None] == label[at][None, :])
                np.fill_diagonal(linked, False)
                some = linked.any(axis=1)
                x, y = _spanning(ids[at][some], linked[np.ix_(some, some)])
                a.append(x[x != y])
                b.append(y[x != y])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

        held, sort = None, None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= 2 * WINDOW:
                sort = held.column("pass")[0].as_py() == held.column("pass")[2 * WINDOW - 1].as_py()
                yield from _by_pass(held.slice(0, 2 * WINDOW), compare) if not sort else [compare(held.slice(0, 2 * WINDOW))]
                held = held.slice(WINDOW)
        if held is not None and held.num_rows:
            yield from _by_pass(held, compare)

    return run


def _by_pass(block: pa.Table, compare) -> Iterator[pa.RecordBatch]:
    passes = np.asarray(block.column("pass"))
    for p in np.unique(passes):
        yield compare(block.filter(pa.array(passes == p)))


def _count_links(cosine: float):
    """Vectors directly linked with each class of side 0 among the classes of side 1 in the same component."""

    def run(table: pa.Table) -> pa.Table:
        component, side, size = (np.asarray(table.column(c)) for c in ("component", "side", "size"))
        order = np.lexsort((size, component))
        cuts = np.flatnonzero(np.diff(component[order]) | np.diff(size[order])) + 1
        row, n, ids = np.asarray(table.column("class")), np.asarray(table.column("n")), []
        counts = []
        for at in np.split(order, cuts):
            left, right = at[side[at] == 0], at[side[at] == 1]
            if not len(left) or not len(right):
                continue
            x, y = (unit_rows(table.column("vector").take(pa.array(k))) for k in (left, right))
            linked = (x @ y.T >= cosine) & (row[left][:, None] != row[right][None, :])
            ids.append(row[left])
            counts.append(linked @ n[right])
        empty = np.zeros(0, np.int64)
        return pa.table({"class": np.concatenate(ids) if ids else empty, "others": np.concatenate(counts).astype(np.int64) if ids else empty})

    return run


def _round_links(classes: DataFrame, cosine: float, passes: int, seed: int, number: int) -> DataFrame:
    """``a, b``: links between classes that one round of passes finds, a spanning part of each window."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema if f.name != "centre")
    keyed = classes.mapInArrow(_keys(passes, seed, number), f"{schema}, keys array<long>")
    keyed = keyed.select("class", "label", "size", "vector", F.posexplode("keys").alias("pass", "key"))
    n = max(1, -(-classes.count() * passes // 20_000))
    ordered = keyed.repartitionByRange(n, "pass", "label", "key", "class").sortWithinPartitions("pass", "label", "key", "class")
    return ordered.mapInArrow(_window_links(cosine), "a long, b long")


def class_components(classes: DataFrame, cosine: float, passes: int, seed: int) -> DataFrame:
    """``id, component`` of every class of ``classes(class, label, size, vector)`` that has a link to another one."""
    labels = materialise(label_centres(classes, cosine), "vector-labels")
    active = labels.select("label", "size", "centre")
    links, found, done = None, None, 0
    while not active.isEmpty():
        part = classes.select("class", "label", "size", "vector").join(active, ["label", "size"])
        new = materialise(_round_links(part, cosine, passes, seed, done), "vector-links")
        done += passes
        of = classes.select(F.col("class").alias("a"), "label", "size")
        ends = new.join(of, "a")
        if found is not None:
            for side in "ab":
                to = found.select(F.col("id").alias(side), F.col("component").alias(f"{side}_to"))
                ends = ends.join(to, side, "left").withColumn(side, F.coalesce(f"{side}_to", side)).drop(f"{side}_to")
        joining = F.when(F.col("a") != F.col("b"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")))
        news = ends.distinct().groupBy("label", "size").agg(F.count(joining).alias("news"))
        news = news.join(new.distinct().join(of, "a").groupBy("label", "size").agg(F.count("*").alias("links")), ["label", "size"])
        judged = labels.join(materialise(news, "vector-news"), ["label", "size"], "left")
        on = (F.col("needed") > done) | F.coalesce(F.col("news") > NEWS * F.col("links"), F.lit(False))
        active = materialise(judged.where(on & (F.col("n") > 1)).select("label", "size", "centre"), "vector-active")
        links = new if links is None else links.unionByName(new)
        found = materialise(components(links, "vector-components"), "vector-found")
    return found if found is not None else classes.select(F.col("class").alias("id"), F.col("class").alias("component"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, seed: int = 1) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    kept_type = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    vector = F.col("embedding").cast(kept_type)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    usable = F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), usable.alias("usable"))
    # Two 64-bit hashes tell vectors apart without a shuffle of the vectors themselves.
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), "vector"), "h2": F.xxhash64(F.lit(2), "vector")})
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vector-rows")
    good, same = rows.where("usable"), ["label", "h1", "h2"]
    heads = good.groupBy(*same).agg(F.min("row").alias("class"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    heads = materialise(heads, "vector-heads")
    classes = good.withColumnRenamed("row", "class").join(heads.select("class", "least", "n"), "class")
    classes = materialise(classes.select("class", "label", F.size("vector").alias("size"), "vector", "least", "n"), "vector-classes")
    found = class_components(classes, cosine, passes, seed)

    placed = materialise(classes.join(found.withColumnRenamed("id", "class"), "class"), "vector-placed")
    sizes = placed.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks"), F.min("least").alias("component_id"))
    sizes = materialise(sizes, "vector-sizes")
    dealt = placed.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    lefts = dealt.select("*", F.col("block").alias("i"), others.alias("j"), F.lit(0).alias("side"))
    rights = dealt.select("*", others.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    groups = max(1, -(-placed.count() // BLOCK))
    small = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.col("component"))
    both = lefts.unionByName(rights).withColumn("deal", F.struct((F.col("blocks") > 1).alias("large"), small.alias("of")))
    both = both.select("deal", "i", "j", "class", "component", "side", "size", "vector", "n")
    counts = both.groupBy("deal", "i", "j").applyInArrow(_count_links(cosine), "class long, others long")
    counts = materialise(counts.groupBy("class").agg(F.sum("others").alias("others")), "vector-counts")

    ids = placed.select("class", "component").join(sizes.select("component", "component_id"), "component").drop("component")
    of_class = heads.join(ids, "class", "left").join(counts, "class", "left")
    of_class = of_class.select(
        *same, (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    of_class = materialise(of_class, "vector-of-class")
    rows = rows.select("vec_id", "h1", "h2", F.when(F.col("usable"), F.col("label")).alias("label"))
    out = rows.join(of_class, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
