"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles. The sketch of a set has ``COORDS`` coordinates, filled in
rounds: round ``r`` throws every element into one bin by a hash of ``(element, r)`` and keeps, per bin, the
smallest ``(r, hash)``; after ``COORDS`` rounds the bin is ``r - COORDS`` for all elements, so at the latest
in ``2 * COORDS`` rounds every coordinate is filled. Rounds stop as soon as no bin is empty. Two sketches
agree in a coordinate with probability equal to the Jaccard similarity, with Chernoff-type concentration.

Bands of ``ROWS`` coordinates give bucket keys. Inside buckets links are searched without listing pairs:

1. Equal sets collapse to one representative (128-bit fingerprint of the set and its size).
2. Star pass: every member of a bucket is compared with the bucket's smallest id, on full sets.
3. Connected components; buckets that lie in one component are done.
4. Block pass for the other buckets: a pair of ids from two components has one id outside the bucket's main
   component. These outsiders, dealt to blocks of about ``BLOCK``, meet every block of the bucket; each pair
   of blocks is compared on full sets and reports a spanning set of links. So no pair of a bucket stays
   undecided, and no bucket is capped or held in one task.

Null, empty or word-free texts have an empty set and link with nothing. Repeated ids are kept as rows and
share one verdict. Columns besides ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

from .components import components
from .wordbytes import Slice, mix, slices

ROWS, BANDS = 5, 32
COORDS = ROWS * BANDS
BLOCK = 128
COLUMNS = 1 << 14
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(s: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a slice, sorted by row: ``(row, hash)``.

    A row with fewer words than ``width`` has one shingle, its whole sequence.
    """
    words, counts = s.hashes(), s.counts
    per_row = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(s.n_rows), per_row)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + s.first[:-1][row]
    left = np.minimum(counts[row], width)
    h = left.astype(np.uint64) * _GOLD
    for k in range(width):
        more = mix((h ^ words[np.minimum(at + k, len(words) - 1)]) * _GOLD + np.uint64(k))
        h = np.where(k < left, more, h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def sketches(row: np.ndarray, h: np.ndarray, n_rows: int, coords: int = COORDS) -> np.ndarray:
    """Sketch of every non-empty row as ``n_rows x coords`` values; a row without elements stays at the maximum."""
    full = np.uint64(2**64 - 1)
    out = np.full((n_rows, coords), full, dtype=np.uint64)
    flat = out.reshape(-1)
    for r in range(2 * coords):
        if not len(row):
            break
        x = mix(h + np.uint64((r + 1) * int(_GOLD) % 2**64))
        bins = (x >> np.uint64(40)) % np.uint64(coords) if r < coords else np.full(len(x), r - coords, np.uint64)
        value = (np.uint64(r) << np.uint64(40)) | (x & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, row * coords + bins.astype(np.int64), value)
        open_rows = (out == full).any(axis=1)
        if not open_rows.all():
            stay = open_rows[row]
            row, h = row[stay], h[stay]
    return out


def _band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sketch), BANDS), dtype=np.uint64)
    keys += np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for k in range(ROWS):
        keys = mix((keys ^ sketch[:, k::ROWS]) * _GOLD + np.uint64(k))
    return keys.view(np.int64)


def _sketch_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                row, h = shingle_sets(s, width)
                n = np.bincount(row, minlength=s.n_rows).astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                prints = []
                for seed in (1, 2):
                    x = mix(h ^ np.uint64(seed * 0x5851F42D4C957F2D % 2**64))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                    prints.append((sums[starts + n] - sums[starts]).view(np.int64))
                keys = _band_keys(sketches(row, h, s.n_rows))
                bands = pa.ListArray.from_arrays(
                    pa.array(np.where(np.arange(s.n_rows + 1) > 0, np.cumsum([0, *np.where(n > 0, BANDS, 0)]), 0), pa.int32()),
                    pa.array(keys[n > 0].reshape(-1)),
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.row0, s.n_rows).cast(pa.int64()), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), bands],
                    names=["doc_id", "n_shingles", "set1", "set2", "bands"],
                )

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the sets in ``left`` with those in ``right``."""
    lens = np.array([len(x) for x in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lens)
    out = np.zeros((len(left), len(right)))
    if len(left) <= 4:
        for k, i in enumerate(left):
            x = sets[i]
            if len(x):
                hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
                out[k] = np.bincount(owner[hit], minlength=len(sets))[right]
        return out
    _, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, n_columns, COLUMNS):
        wide = min(COLUMNS, n_columns - low)
        a, b = np.searchsorted(column, [low, low + wide])
        marks = np.zeros((len(sets), wide), dtype=np.float32)
        marks[owner[a:b], column[a:b] - low] = 1
        out += marks[left] @ marks[right].T
    return out


def _links_in_group(width: int, threshold: int):
    """Exact links of the texts of side 0 with those of side 1, as a spanning set.

    Texts that lie in one component already are not linked again.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        sets: list[np.ndarray] = []
        for s in slices(table.column("text")):
            row, h = shingle_sets(s, width)
            sets.extend(np.split(h, np.cumsum(np.bincount(row, minlength=s.n_rows))[:-1]))
        lens = np.array([len(x) for x in sets], dtype=np.int64)
        _, root = np.unique(table.column("component").to_numpy(), return_inverse=True)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        both = _overlaps(sets, left, right)
        linked = (both > 0) & (100 * both >= threshold * (lens[left][:, None] + lens[right][None, :] - both))
        a, b = [], []
        for k, i in enumerate(left):
            for j in right[linked[k] & (root[right] != root[i])]:
                if root[i] != root[j]:
                    a.append(ids[i])
                    b.append(ids[j])
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; ``threshold`` is in per cent.

    ``component_id`` is the smallest ``doc_id`` reachable over links, ``kept`` is ``doc_id = component_id``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>"
    sketched = materialise(texts.mapInArrow(_sketch_batches(width), schema), "sketch")
    key = ["set1", "set2", "n_shingles"]
    reps = materialise(
        sketched.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")),
        "sketch-reps",
    )
    banded = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(shared, "sketch-shared")  # of known size, and a bucket with most documents can be split
    members = materialise(banded.join(shared, ["band", "key"]).select("band", "key", "id", "hub", "n"), "sketch-buckets")
    ids = members.select("id").distinct()
    wanted = materialise(texts.withColumnRenamed("doc_id", "id").join(ids, "id").dropDuplicates(["id"]), "sketch-texts")

    stars = materialise(members.where("id <> hub").select("hub", "id").distinct(), "sketch-stars")
    parts = stars.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("parts"))
    sided = stars.join(parts, "hub").select(
        "hub", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).alias("part"), "id", F.lit(1).alias("side")
    )
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("id"), F.lit(0).alias("side"))
    group = sided.unionByName(hubs).join(wanted, "id").withColumn("component", F.col("id"))
    pairs = "a long, b long"
    first = materialise(group.groupBy("hub", "part").applyInArrow(_links_in_group(width, threshold), pairs), "sketch-links")
    found = components(first, "sketch-components")

    placed = members.join(found, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    open_buckets = (
        sizes.groupBy("band", "key")
        .agg(F.max_by("component", "n").alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
        .where("most < n and n > 2")
        .select("band", "key", "main", *(F.ceil(F.expr(n) / F.lit(BLOCK)).cast("long").alias(c) for c, n in (("outs", "n - most"), ("alls", "n"))))
    )
    dealt = placed.join(open_buckets, ["band", "key"])
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(11)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["band", "key", "id", "component", "outer", "inner", "side"]
    outside = dealt.where("component <> main").select("*", block("outs").alias("outer"), upto("alls").alias("inner"), F.lit(0).alias("side"))
    inside = dealt.select("*", block("alls").alias("inner"), upto("outs").alias("outer"), F.lit(1).alias("side"))
    paired = outside.select(columns).unionByName(inside.select(columns))
    rest = paired.join(wanted, "id").groupBy("band", "key", "outer", "inner").applyInArrow(_links_in_group(width, threshold), pairs)
    links = first.unionByName(rest)
    final = components(links, "sketch-components")

    by_set = reps.join(final, "id", "left").select(*key, F.coalesce("component", "id").alias("found"))
    joined = sketched.drop("bands").join(by_set, key, "left")
    component = F.coalesce("found", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
