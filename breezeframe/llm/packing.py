"""Best-fit packing with conflicts: no bin holds two pieces of one source or of one duplicate cluster.

Texts longer than the capacity are cut into full pieces and a remainder. Pieces are dealt by a hash of their
id to shards of about ``SHARD`` pieces, whose number follows the input; a shard packs on its own, so tasks
stay small whatever share one source has, and clusters that lie in two shards cannot conflict. Inside a
shard pieces go by falling size; open bins are kept in order of residual, and each carries a bitmap of its
sources and one of its clusters. The search starts at the successor of the piece's size and goes on until the
tightest compatible bin is found; only if there is none a new bin opens.

Empty or null texts are pieces of size 0. Null sources are one source; a null cluster conflicts with nothing.
Repeated rows are pieces of their own. An empty table gives no bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

CAPACITY = 2048
SHARD = 20_000


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken in the given order. Sources and clusters are small ints, -1 for none."""
    n = len(sizes)
    words = lambda codes: (int(codes.max(initial=-1)) >> 6) + 1
    source_map = np.zeros((max(1, words(sources)), n), dtype=np.uint64)
    cluster_map = np.zeros((max(1, words(clusters)), n), dtype=np.uint64)
    keys = np.zeros(n + 1, dtype=np.int64)  # residual << 32 | bin, ascending
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    residual = np.zeros(n, dtype=np.int64)
    opened = 0
    for i in range(n):
        size, source, cluster = int(sizes[i]), int(sources[i]), int(clusters[i])
        source_bit = np.uint64(1 << (source & 63)) if source >= 0 else np.uint64(0)
        cluster_bit = np.uint64(1 << (cluster & 63)) if cluster >= 0 else np.uint64(0)
        in_source, in_cluster = source_map[max(source, 0) >> 6], cluster_map[max(cluster, 0) >> 6]
        at, step, place = int(np.searchsorted(keys[:opened], size << 32)), 32, -1
        while at < opened:
            near = keys[at : min(at + step, opened)] & 0xFFFFFFFF
            fits = ((in_source[near] & source_bit) | (in_cluster[near] & cluster_bit)) == 0
            k = int(fits.argmax())
            if fits[k]:
                place = at + k
                break
            at, step = at + step, step * 4
        if place < 0:
            b, place, left = opened, opened, capacity
            opened += 1
        else:
            b = int(keys[place] & 0xFFFFFFFF)
            left = int(residual[b])
        offsets[i], bins[i] = capacity - left, b
        residual[b] = left - size
        new = (left - size) << 32 | b
        to = int(np.searchsorted(keys[:place], new))
        keys[to + 1 : place + 1] = keys[to:place].copy()
        keys[to] = new
        if source >= 0:
            source_map[source >> 6, b] |= source_bit
        if cluster >= 0:
            cluster_map[cluster >> 6, b] |= cluster_bit
    return bins, offsets


def _pack(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["size", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")
        sources = pd.factorize(pieces["source"].fillna("\0none"))[0]
        cluster = pieces["cluster"]
        shared = cluster.where(cluster.duplicated(keep=False))  # a cluster with one piece here conflicts with nothing
        bins, offsets = best_fit(pieces["size"].to_numpy(), sources, pd.factorize(shared)[0], capacity)
        used = np.bincount(bins, pieces["size"].to_numpy(), minlength=1)
        out = pieces[["doc_id", "piece", "first_word", "size", "shard"]].copy()
        return out.assign(bin=bins, bin_offset=offsets, bin_used=used[bins].astype(np.int64))

    return run


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """A row for each piece: ``doc_id, piece, first_word, size, shard, bin, bin_offset, bin_used``.

    ``(shard, bin)`` names a bin; ``first_word`` is where the piece starts in its document.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("words"),
        source.cast("string").alias("source"), cluster.cast("long").alias("cluster"),
    )
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("words") / F.lit(capacity)) - 1)
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("piece") * capacity
    pieces = pieces.select(
        "doc_id", "piece", first.alias("first_word"), F.least(F.lit(capacity).cast("long"), F.col("words") - first).alias("size"), "source", "cluster"
    )
    pieces = materialise(pieces, "pack-pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(23)), F.lit(shards)))
    schema = "doc_id long, piece long, first_word long, size long, shard long, bin long, bin_offset long, bin_used long"
    return dealt.groupBy("shard").applyInPandas(_pack(capacity), schema)
