"""Toxicity scores from an FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the presence of word unigrams, bigrams and one-word skip-grams, lower-cased in A-Z, hashed to
``1 << BITS`` coordinates. Training is FTRL-proximal: per-coordinate learning rates and L1, so that few
weights are non-zero; those few are what tasks get. Coordinates seen in fewer than ``LEAST`` positive rows
are not learnt, or they would only name single documents. Every ``FOLD``-th training row is kept back to fit
slope and offset of the final logistic (Platt scaling). The training rows are a bounded sample: at most
``SAMPLE`` labelled documents, chosen by a hash of their id; the model is fitted in one task. Scoring reads
every whole text.

Null or empty texts have no features and get the score of the bias. Labels that are null are ignored; of
several labels of one id the largest counts. Without any label every score is 0.5. Repeated rows are scored
each. Only ``doc_id`` and ``text`` of the documents and ``doc_id`` and ``toxic`` of the labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbytes import PUNCTUATED, Slice, mix, slices

BITS = 20
SAMPLE = 12_000
EPOCHS = 6
LEAST = 5
FOLD = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.01
REJECT = 0.7


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """``(row, coordinate)`` of every unigram, bigram and skip-gram of a slice, with repeats."""
    words, mask = s.hashes(), np.uint64((1 << BITS) - 1)
    rows, coords = [s.row], [words & mask]
    for gap in (1, 2):
        if len(words) > gap:
            near = s.row[gap:] == s.row[:-gap]
            rows.append(s.row[gap:][near])
            pair = mix(words[:-gap] * np.uint64(0xD6E8FEB86659FD93) + words[gap:] + np.uint64(gap))
            coords.append(pair[near] & mask)
    return np.concatenate(rows), np.concatenate(coords).astype(np.int64)


def fit_ftrl(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and values of the non-zero weights, and the bias, after ``epochs`` passes in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    strict = np.full((1 << BITS) + 1, L1)
    strict[bias] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = (np.sign(zi) * strict[at] - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= strict[at], 0.0, w)

    for _ in range(epochs):
        for x, y in zip(examples, labels, strict=True):
            at = np.append(x, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    kept = np.flatnonzero(w[:bias])
    return kept, w[kept], float(w[bias])


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic over margins, by Newton steps on smoothed labels."""
    up, down = (labels == 1).sum(), (labels == 0).sum()
    goal = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        v = p * (1 - p)
        hess = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, [((p - goal) * margins).sum(), (p - goal).sum()])
        a, b = max(1e-3, a - np.clip(step[0], -1, 1)), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by([("place", "ascending"), ("doc_id", "ascending")])
    examples: list[np.ndarray] = []
    for s in slices(table.column("text"), gaps=PUNCTUATED):
        row, coord = features(s)
        keys = np.unique(row.astype(np.int64) << BITS | coord)
        examples.extend(np.split(keys & ((1 << BITS) - 1), np.searchsorted(keys >> BITS, np.arange(1, s.n_rows))))
    labels = table.column("toxic").to_numpy()
    seen = np.bincount(np.concatenate([x for x, y in zip(examples, labels, strict=True) if y], dtype=np.int64) if labels.any() else [], minlength=1 << BITS)
    examples = [x[seen[x] >= LEAST] for x in examples]
    learn = np.arange(len(examples)) % FOLD > 0
    at, w, bias = fit_ftrl([x for x, k in zip(examples, learn, strict=True) if k], labels[learn])
    if not learn.all() and (labels[~learn] == 1).any():
        dense = np.zeros(1 << BITS)
        dense[at] = w
        margins = np.array([bias + dense[x].sum() for x, k in zip(examples, learn, strict=True) if not k])
        slope, offset = platt(margins, labels[~learn])
        w, bias = slope * w, slope * bias + offset
    return pa.table({"at": pa.array(np.append(at, -1), pa.int64()), "w": pa.array(np.append(w, bias), pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights and bias learnt from at most ``sample`` labelled rows."""
    place = F.xxhash64(F.col("doc_id").cast("long"), F.lit(9))
    chosen = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("place", place)
        .orderBy("place", "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of three numbers
    found = rows.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_fit, "at long, w double").toPandas()
    inside = found["at"].to_numpy() >= 0
    bias = found["w"].to_numpy()[~inside]
    return found["at"].to_numpy()[inside], found["w"].to_numpy()[inside], float(bias[0]) if len(bias) else 0.0


def _scores(at: np.ndarray, w: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[at] = w
        used = table != 0
        for batch in batches:
            for s in slices(batch.column(1), gaps=PUNCTUATED):
                row, coord = features(s)
                hit = used[coord]
                keys = np.unique(row[hit].astype(np.int64) << BITS | coord[hit])
                margin = bias + np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], s.n_rows)
                score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                ids = batch.column(0).slice(s.row0, s.n_rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``; ``predicted`` is 1 from ``REJECT`` on."""
    at, w, bias = fit(docs, labels, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_scores(at, w, bias), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))
