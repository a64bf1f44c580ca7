"""Whitening of vectors on the leading components of their covariance, refined from float32 eigenvectors.

Entries become integers ``x = floor(256 * c)``. The fit list holds each distinct ``x`` once; its sums, its
covariance (divisor ``n``, centred before multiplying) and the covariance of its whitened form are partial sums
of Arrow tasks, one small set a task, added by Spark. Only numbers of the dimensions' size reach the driver:
``d`` sums and ``d * d`` covariances. The driver solves ``d`` by ``d`` once: eigenvectors in float32, then the
iterations of Ogita and Aishima in extended precision, each a few matrix products, which double the right
digits. Eigenvalues closer than the iteration's own error bound form a cluster, whose directions it cannot
tell apart; each cluster is turned by the eigenvectors of its small shifted block (a sub-solve), after which
the bound shrinks and the cluster parts.

Rows whose vector is null or has null or non-finite entries go, as do entries of 2**55 and more, which have
no integer form, and vectors of another length than the most common one (of equal counts, the longer), which
are not of the same space. Components whose eigenvalue is not above rounding (``d * 2**-52`` of the trace) have no
whitened form and are left out: equal vectors, one vector, or an empty table give no rows. Equal
eigenvalues keep an arbitrary order and basis. The largest entry of a component is positive. Repeated rows
and ids are answered each; a null id stays null. ``deviation`` is exact, null from 10**38 on. Only the id and vector
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

SCALE = 256
KEPT = 4
ROUNDS = 8


class Model(NamedTuple):
    n: int
    sums: list[int]
    components: np.ndarray  # one column each
    values: np.ndarray
    trace: float
    identity_error: float


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Positions of the eigenvalues in groups: neighbours in order within ``apart`` are in one group."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order]) > apart) + 1)


def refined_eigen(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a symmetric matrix and their unit eigenvectors, as columns, to double precision."""
    wide = np.longdouble
    scale = np.abs(matrix).max(initial=0.0)
    if not scale > 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = (np.asarray(matrix, wide) + np.asarray(matrix, wide).T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    size, even = lambda m: np.sqrt((m * m).sum()), lambda m: (m + m.T) / 2
    values, one, norm = np.diag(a), np.eye(len(a), dtype=wide), size(a)
    for _ in range(rounds):
        r = even(one - x.T @ x)  # exact symmetry keeps the columns orthogonal however small a gap is
        s = even(x.T @ (a @ x))
        values = np.diag(s) / (1 - np.diag(r))
        apart = 2 * (size(s - np.diag(values)) + norm * size(r))
        groups = clusters(values, apart)
        label = np.empty(len(a), int)
        for number, group in enumerate(groups):
            label[group] = number
        same = label[:, None] == label[None, :]
        gap = np.where(same, 1, values[None, :] - values[:, None])
        step = np.where(same, r / 2, (s + values[None, :] * r) / gap)
        x = x + x @ step
        for group in groups:
            if len(group) > 1:
                x[:, group] = x[:, group] @ _turn(a, x[:, group], values[group].mean())
        if np.abs(step).max() < 4 * np.finfo(wide).eps:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(float), x[:, order].astype(float)


def _turn(a: np.ndarray, basis: np.ndarray, shift: float) -> np.ndarray:
    """The rotation of a cluster's basis onto eigenvectors of its block, shifted so that only the cluster's spread is left."""
    block = basis.T @ (a @ basis) - shift * (basis.T @ basis)
    block = (block + block.T) / 2
    largest = np.abs(block).max()
    if largest == 0:
        return np.eye(len(block), dtype=a.dtype)
    return np.linalg.eigh((block / largest).astype(float))[1].astype(a.dtype)


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that remain."""
    entries = F.col(column).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**55))
    rows = vectors.where(F.col(column).isNotNull() & finite)
    return rows.select(F.col(id_column).alias("vec_id"), F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _common_length(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.num_columns - 1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sums over all rows of ``partial``, whose result has the same shape for every matrix of row vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(_matrix(batch)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

    value: Column = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    cells = rows.select("x").mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum(value).alias("v"))
    return np.array([r["v"] for r in cells.orderBy("at").collect()], dtype=object if kind == "long" else float)


def _centre(sums: list[int], n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Rows less the mean ``S / n``: the whole part is taken away in integers."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole) - rest


def fit(rows: DataFrame, kept: int = KEPT) -> Model | None:
    """The model of the distinct vectors in ``rows(x)``, all of one length; None without rows."""
    listed = materialise(rows.select("x").distinct(), "whitening-fit-list")
    halves = lambda x: np.stack([np.ones_like(x).sum(axis=0), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
    total = _summed(listed, halves, "long")
    if not len(total):
        return None
    count, high, low = ([int(v) for v in part] for part in total.reshape(3, -1))
    n, sums = count[0], [(h << 32) + s for h, s in zip(high, low, strict=True)]
    centre = _centre(sums, n)
    cells = _summed(listed, lambda x: (lambda y: y.T @ y)(centre(x)), "double")
    covariance = cells.reshape(len(sums), len(sums)) / n
    values, components = refined_eigen(covariance)
    trace = float(np.trace(covariance))
    held = values[:kept] > len(sums) * 2.0**-52 * trace
    values, components = values[:kept][held], components[:, :kept][:, held]
    if not len(values):
        return Model(n, sums, components, values, trace, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ components / np.sqrt(values)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(listed, moments, "double").reshape(len(values) + 1, -1) / n
    error = np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(len(values))).max()
    return Model(n, sums, components, values, trace, float(error))


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[str]:
    """Decimal digits of ``sum((n * x - S) ** 2)`` of each row, exact at any size."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    least, most = x.min(axis=0), x.max(axis=0)
    reach = max(max(abs(int(b) - int(w)), abs(int(a) - int(w))) for a, b, w in zip(least, most, whole, strict=True)) + 1
    kind = np.int64 if len(sums) * (n * reach) ** 2 < 2**63 else object
    u = n * (x.astype(kind) - whole.astype(kind)) - np.array(rest, dtype=kind)
    return [str(v) for v in (u * u).sum(axis=1).tolist()]


def _whiten(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, centre = len(model.values), _centre(model.sums, model.n)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            w = centre(x) @ model.components / np.sqrt(model.values)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(_deviations(x, model.sums, model.n)).take(at), pa.array(w.ravel()), pa.array(np.tile(model.values / model.trace, len(x))),
                ],
                names=["vec_id", "component", "deviation", "whitened", "explained"],
            )

    return run


def whiten(vectors: DataFrame, kept: int = KEPT, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each remaining row and component."""
    rows = integer_vectors(vectors, id_column, column)
    length = _common_length(rows)
    rows = rows.where(F.size("x") == length)
    model = fit(rows, kept) if length else None
    if model is None or not len(model.values):
        model, rows = Model(1, [0], np.ones((1, 1)), np.ones(1), 1.0, 0.0), rows.where(F.lit(False))
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.mapInArrow(_whiten(model), f"vec_id {kind}, component int, deviation string, whitened double, explained double")
    return out.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"),
        "whitened", "explained", F.lit(model.identity_error).alias("identity_error"),
    )
