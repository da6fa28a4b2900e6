"""Whitening of embeddings by a blockwise TSQR and a one-sided Jacobi SVD.

Entries become integers on a grid, so that sums and centring are exact.  Every task folds its centred
rows, block by block, into one triangle R; triangles are folded in a tree of small groups until one
is left.  Plane rotations make the columns of R orthogonal: their lengths over the square root of n
are the standard deviations, the accumulated rotations the components.  No product of the data
with itself is formed, which would square its condition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from beaconlake.llm.scratch import Scratch

GRID = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: An entry of this magnitude or more has no place on the grid that sums exactly.
LARGEST = float(1 << 40)
#: Rows that are turned into arrays at once, and partial results that one task folds.
BLOCK = 2048
FAN = 32
#: Components below this part of the largest deviation are rounding, not variance.
RANK = 1e-12


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of a square matrix, by one-sided rotations.

    A sweep rotates every pair of columns once, in rounds of disjoint pairs that are rotated
    together; it ends when no pair is further from orthogonal than rounding.
    """
    d = r.shape[1]
    start = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    work = np.asfortranarray(r[:, start].T.copy())  # rows are columns of r
    turned = np.eye(d)
    ring = np.arange(d + d % 2)
    half = len(ring) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = ring[:half], ring[half:][::-1]
            real = (p < d) & (q < d)
            p, q = np.minimum(p[real], q[real]), np.maximum(p[real], q[real])
            x, y = work[p], work[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            scale = np.sqrt(xx) * np.sqrt(yy)
            off = np.divide(np.abs(xy), scale, out=np.zeros_like(xy), where=scale > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-16
            p, q, x, y, xx, yy, xy = p[turn], q[turn], x[turn], y[turn], xx[turn], yy[turn], xy[turn]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = (c * t)[:, None]
            c = c[:, None]
            work[p], work[q] = c * x - s * y, s * x + c * y
            u, v = turned[p], turned[q]
            turned[p], turned[q] = c * u - s * v, s * u + c * v
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
        if worst <= 1e-15:
            break
    sigma = np.linalg.norm(work, axis=1)
    order = np.argsort(-sigma, kind="stable")
    components = np.zeros((d, d))
    components[start] = turned[order].T
    return sigma[order], components


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one batch as integers on the grid."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(flat * GRID).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column(part.num_columns - 1), dim)


def _spread(x: np.ndarray, total: list[int], n: int) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers if they suffice, else as Python's."""
    top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *(abs(s) // n + 1 for s in total))
    if 2 * n * (top + 1) < 1 << 62:
        return n * x - np.array(total, dtype=np.int64)
    return n * x.astype(object) - np.array(total, dtype=object)


def _fold(parts: DataFrame, scratch: Scratch, label: str, merge: Callable[[bytes | None, bytes], bytes]) -> bytes | None:
    """The results of all tasks (id, data) folded in groups of FAN, in order of id, until one is left; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i // FAN != group and held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([held], pa.binary())], names=["id", "data"])
                    held = None
                group, held = i // FAN, merge(held, data)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([held], pa.binary())], names=["id", "data"])

    level, ids = 0, scratch.table(parts, f"{label}0")
    while (top := ids.agg(F.max("id")).first()[0]) is not None:
        if top == 0:
            return bytes(ids.first().data)
        level += 1
        groups = ids.repartition(max(1, -(-(top + 1) // FAN)), F.floor(F.col("id") / FAN)).sortWithinPartitions("id")
        ids = scratch.table(groups.mapInArrow(run, "id bigint, data binary"), f"{label}{level}")
    return None


def _partial(fits: DataFrame, dim: int, step: Callable[[bytes | None, np.ndarray], bytes]) -> DataFrame:
    """One row (id, data) of every task that has vectors: what ``step`` makes of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, x in _blocks(batches, dim):
            held = step(held, x)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held], pa.binary())], names=["id", "data"])

    return fits.mapInArrow(run, "id bigint, data binary")


class Whitening:
    """Fitted: n, exact sums S, components (columns), standard deviations, explained shares."""

    def __init__(self, n: int, total: list[int], sigma: np.ndarray, components: np.ndarray, explained: np.ndarray):
        self.n, self.total, self.sigma, self.components, self.explained = n, total, sigma, components, explained

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of vectors on the grid."""
        centred = _spread(x, self.total, self.n).astype(np.float64) / self.n
        return centred @ self.components / self.sigma


def fit(fits: DataFrame, scratch: Scratch, dim: int, keep: int) -> Whitening | None:
    """Components of the one column of ``fits``, all whose vectors are finite and of ``dim`` entries; None without rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for _, x in _blocks(batches, dim):
            n += len(x)
            total = [a + b for a, b in zip(total, (x.sum(0) if np.abs(x).max() < 1 << 48 else x.astype(object).sum(0)).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])], names=["i", "n", "s"])

    held = fits.mapInArrow(sums, "i int, n bigint, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(held.collect())  # one row per dimension
    if not found:
        return None
    n, total = found[0].n, [int(r.s) for r in found]

    def triangle(r: bytes | None, x: np.ndarray) -> bytes:
        return _triangle(r, _spread(x, total, n).astype(np.float64) / n, dim)

    r = _fold(_partial(fits, dim, triangle), scratch, "r", lambda a, b: _triangle(a, np.frombuffer(b).reshape(-1, dim), dim))
    sigma, components = jacobi(np.frombuffer(r).reshape(dim, dim))
    real = sigma > RANK * sigma[0] if sigma[0] > 0 else np.zeros(dim, bool)
    keep = min(keep, int(real.sum()))
    explained = sigma[:keep] ** 2 / (sigma**2).sum() if keep else sigma[:0]
    return Whitening(n, total, sigma[:keep] / np.sqrt(n), components[:, :keep], explained)


def _triangle(r: bytes | None, rows: np.ndarray, dim: int) -> bytes:
    """The square triangle of the rows below those of ``r``."""
    rows = rows if r is None else np.concatenate((np.frombuffer(r).reshape(dim, dim), rows))
    made = np.linalg.qr(rows, mode="r")
    return np.concatenate((made, np.zeros((dim - len(made), dim)))).tobytes()


def _moments(held: bytes | None, n: int, mean: np.ndarray, scatter: np.ndarray) -> bytes:
    """Count, mean and centred scatter of two sets together."""
    k = len(mean)
    if held is not None:
        old = np.frombuffer(held)
        m, gap, n_old = old[1 : k + 1], mean - old[1 : k + 1], old[0]
        both = n_old + n
        scatter = scatter + old[k + 1 :].reshape(k, k) + np.outer(gap, gap) * (n_old * n / both)
        mean, n = m + gap * (n / both), both
    return np.concatenate(([n], mean, scatter.ravel())).tobytes()


def identity_error(fits: DataFrame, scratch: Scratch, dim: int, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity; centred by the mean of each set before multiplying."""
    k = len(fitted.sigma)

    def step(held: bytes | None, x: np.ndarray) -> bytes:
        w = fitted.apply(x)
        mean = w.mean(0)
        return _moments(held, len(w), mean, (w - mean).T @ (w - mean))

    def merge(held: bytes | None, more: bytes) -> bytes:
        one = np.frombuffer(more)
        return _moments(held, int(one[0]), one[1 : k + 1], one[k + 1 :].reshape(k, k))

    found = np.frombuffer(_fold(_partial(fits, dim, step), scratch, "moments", merge))
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite and within LARGEST."""
    fine = F.forall(vec, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))  # false for nan: it is the greatest
    return vectors.filter(F.col(vec).isNotNull() & (F.size(vec) > 0) & fine)


def whiten(vectors: DataFrame, *, key: str = "vec_id", vec: str = "embedding", keep: int = COMPONENTS, label: str = "whitening") -> DataFrame:
    """A row per usable vector and component up to ``keep``: key, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    Each entry c becomes x = floor(GRID * c) + SHIFT.  ``deviation`` is the sum over dimensions of
    (n * x - S)^2, S the sums over all n usable vectors; where that passes 2^63 it is null, and
    deviation_exact (decimal(38,0)) has it.  ``explained`` is the component's share of the variance,
    ``identity_error`` one value for all rows.

    Vectors that are null or empty, hold null or non-finite entries or one of LARGEST or more, or
    have another length than most (the longer on a tie) are dropped.  Components without
    variance, beyond RANK of the largest deviation, are left out: equal vectors, or a single one, give no
    rows, and neither does an empty table.  Repeated rows count and come out each; null keys are kept.
    """
    scratch = Scratch(vectors.sparkSession, label)
    good = usable(vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec")), "vec")
    kind = vectors.schema[key].dataType
    schema = f"key {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    lengths = good.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    none = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    if lengths is None:
        return none
    dim = lengths.dim
    good = good.filter(F.size("vec") == dim)
    fitted = fit(good.select("vec"), scratch, dim, keep)
    k = len(fitted.sigma)
    if not k:
        return none
    error = identity_error(good.select("vec"), scratch, dim, fitted)
    arrow_key = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim):
            gap = _spread(x, fitted.total, fitted.n)
            small = gap.dtype == np.int64 and int(np.abs(gap).max(initial=0)) ** 2 * dim < 1 << 63
            deviation = [int(v) for v in (gap * gap if small else gap.astype(object) ** 2).sum(1)]
            rows = len(x)
            again = np.repeat(np.arange(rows), k)
            columns = [
                part.column(0).cast(arrow_key).take(pa.array(again)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, fitted.n)),
                pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()).take(pa.array(again)),
                pa.array(fitted.apply(x).ravel()),
                pa.array(np.tile(fitted.explained, rows)),
                pa.array(np.full(rows * k, error)),
                pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)).take(pa.array(again)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return good.select("key", "vec").mapInArrow(run, schema).withColumnRenamed("key", key)


def op12_whitening(vectors: DataFrame) -> DataFrame:
    """Contract columns of :func:`whiten`, which states nulls, lengths, repeats and empty tables."""
    return whiten(vectors)
