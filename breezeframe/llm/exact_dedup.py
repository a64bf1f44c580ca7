"""Exact deduplication by Grace hashing.

The content of a text is the text without ``[\\x20\\x09-\\x0D]``. Each task first collapses its own rows in an
open-addressing table, so at most one copy of a content leaves a table. The survivors are dealt by a hash to
buckets; a bucket streams through a table of at most ``TABLE_BYTES`` of distinct contents. What finds its
content there, compared in full, is resolved; what finds the table full is written to spill files in the
shared folder and dealt again by the next level's hash, until nothing is left. A table takes at least one
content, so levels end; repeated contents never fill a table, so one group may hold most rows.

Null counts as empty. Of equal texts the row with the most code points stays, then the smallest ``doc_id``.
Repeated rows are members of their own; rows without ``doc_id`` too. Other columns are ignored, and an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

TABLE_BYTES = 48 << 20
_SPACE = b" \t\n\v\f\r"


class Table:
    """Open addressing with linear probing; equal means equal content, not equal hash."""

    def __init__(self, limit: int) -> None:
        self.limit, self.bytes = limit, 0
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[int] = []

    def _slot(self, h: int, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (e := int(self.slots[at])) >= 0:
            if content is not None and self.hashes[e] == h and self.contents[e] == content:
                break
            at = (at + 1) & mask
        return at

    def find(self, h: int, content: bytes) -> int | None:
        e = int(self.slots[self._slot(h, content)])
        return self.values[e] if e >= 0 else None

    def add(self, h: int, content: bytes, value: int) -> bool:
        """False when the table is full."""
        if self.contents and self.bytes + len(content) + 100 > self.limit:
            return False
        if 2 * len(self.contents) >= len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
            for e, old in enumerate(self.hashes):
                self.slots[self._slot(old, None)] = e
        self.slots[self._slot(h, content)] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 100
        return True


def _collapse(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, table = TaskContext.get().partitionId() << 40, 0, Table(limit)
        for batch in batches:
            entries, hashes, shas, contents, points = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                content = text.encode().translate(None, _SPACE)
                digest = hashlib.sha256(content)
                h = int.from_bytes(digest.digest()[:8], "big") >> 1
                entry = table.find(h, content)
                new = entry is None
                if new:
                    entry = base + number
                    number += 1
                    if not table.add(h, content, entry):
                        table = Table(limit)
                        table.add(h, content, entry)
                entries.append(entry)
                hashes.append(h)
                shas.append(digest.hexdigest())
                contents.append(content if new else None)
                points.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(entries, pa.int64()), pa.array(hashes, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(points, pa.int64()), pa.array(contents, pa.binary())],
                names=["doc_id", "entry", "h", "sha", "points", "content"],
            )

    return run


def _resolve(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(limit)
        for batch in batches:
            classes, left = [], []
            for entry, h, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = table.find(h, content)
                if found is None and table.add(h, content, entry):
                    found = entry
                classes.append(found)
                left.append(content if found is None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(left, pa.binary()), pa.array(classes, pa.int64())],
                names=["entry", "h", "content", "class"],
            )

    return run


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, entry long, h long, sha string, points long, content binary"
    rows = materialise(texts.mapInArrow(_collapse(table_bytes), schema), "grace-rows")
    todo, resolved, level = rows.where("content is not null").select("entry", "h", "content"), None, 0
    while True:
        size = todo.agg(F.count("*"), F.sum(F.length("content") + 100)).first()
        if level and not size[0]:
            break
        buckets = max(1, -(-int(size[1] or 0) * 4 // table_bytes))
        dealt = todo.repartition(buckets, F.xxhash64("h", F.lit(level)))
        done = materialise(dealt.mapInArrow(_resolve(table_bytes), "entry long, h long, content binary, class long"), "grace-level")
        found = done.where("class is not null").select("entry", "class")
        resolved = found if resolved is None else resolved.unionByName(found)
        todo, level = done.where("class is null").select("entry", "h", "content"), level + 1

    members = rows.drop("content", "h").join(resolved, "entry").drop("entry")
    best = F.min(F.struct((-F.col("points")).alias("short"), F.col("doc_id").alias("id")))
    groups = members.groupBy("class").agg(best.alias("best"), F.count("*").alias("group_size"))
    # Written, so that the join below deals both sides itself and a class with most rows can be split.
    groups = materialise(groups.select("class", F.col("best.id").alias("keep_id"), "group_size"), "grace-groups")
    out = members.join(groups, "class")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
