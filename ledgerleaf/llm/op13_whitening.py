"""Embedding whitening by cyclic Jacobi rotations of a distributed centred scatter.

Vectors are laid on a grid of integers, so that equal ones can be told exactly; each distinct one counts once in the
fit. Two passes over the distinct vectors give exact sums and then the scatter of centred entries, as one triangle a
task, added up by Spark. The driver, which holds nothing but dimension by dimension numbers, rotates pairs of
dimensions until no off-diagonal entry counts beside its diagonal ones; that criterion keeps small eigenvalues accurate.
The matrix then goes out with the tasks that whiten all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C

#: Grid points of an entry: floor(STEPS * entry) + SHIFT, below LARGEST in size.
STEPS, SHIFT, LARGEST = 64, 1_000_000, 1 << 31
#: Rounds over all pairs of dimensions at most; some ten are usual.
SWEEPS = 60
#: An eigenvalue below this share of the largest is rounding: its direction has no extent and no component.
LEAST = 1e-13


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums of entries; components in columns, by falling eigenvalue; trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n @ (self.components / np.sqrt(self.eigenvalues))


def _grid(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, pa.Array]:
    """Which rows have a vector (of this length, if given), and the entries of those as int64 grid points."""
    sizes = pc.fill_null(pc.list_value_length(column), 0)
    has = pc.greater(sizes, 0) if width is None else pc.equal(sizes, width)
    where = np.flatnonzero(has.to_numpy(zero_copy_only=False))
    lists = column.take(pa.array(where))
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(STEPS * flat)
        bad = ~(np.abs(scaled) < LARGEST - 2 * SHIFT)
    edge = np.concatenate([[0], np.cumsum(n)])
    fine = np.add.reduceat(bad, edge[:-1]) == 0 if len(n) else np.empty(0, bool)
    points = scaled[np.repeat(fine, n)].astype(np.int64) + SHIFT
    return where[fine], pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n[fine])]).astype(np.int32), pa.array(points.astype(np.int32)))


def _points(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_grid(batch.column(0))[1]], names=["x"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _triangle(width: int, rows):
    """One scatter a task: the products of all rows' entries, summed, for each pair of dimensions i <= j."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            d = rows(_matrix(batch.column(0), width))
            total[: d.shape[1], : d.shape[1]] += d.T @ d
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def _scatter(distinct: DataFrame, width: int, rows) -> np.ndarray:
    """Triangles of all tasks meet by pair of dimensions; the driver gets their sums: width * (width + 1) / 2 numbers."""
    parts = distinct.mapInArrow(_triangle(width, rows), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in parts.collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix, by rotations of cyclic pairs.

    A pair is done when its off-diagonal entry is below the rounding of the geometric mean of its diagonal ones.
    """
    a, width = a.copy(), len(a)
    v, eps = np.eye(width), np.finfo(float).eps
    for _ in range(SWEEPS):
        still = True
        for p in range(width - 1):
            for q in range(p + 1, width):
                x, y, z = a[p, p], a[q, q], a[p, q]
                if z == 0 or abs(z) <= eps * math.sqrt(abs(x * y)):
                    continue
                still = False
                tau = (y - x) / (2 * z)
                t = math.copysign(1, tau) / (abs(tau) + math.hypot(1, tau))
                c = 1 / math.hypot(1, t)
                s = t * c
                left, right = a[:, p].copy(), a[:, q].copy()
                a[:, p], a[:, q] = c * left - s * right, s * left + c * right
                a[p, :], a[q, :] = a[:, p], a[:, q]
                a[p, p], a[q, q] = x - t * z, y + t * z
                a[p, q] = a[q, p] = 0
                left, right = v[:, p].copy(), v[:, q].copy()
                v[:, p], v[:, q] = c * left - s * right, s * left + c * right
        if still:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def fit(vectors: DataFrame, column: str = "embedding", components: int = 16) -> tuple[Whitening | None, float, int]:
    """The whitening of a table's distinct vectors, the largest entry of (whitened covariance - identity), and the length.

    Null vectors, those with null, NaN or infinite entries and empty ones are left out, as are entries of 2^25 and more in
    size, which the grid cannot hold. Where lengths differ, the most frequent one among distinct vectors counts, of ties
    the greatest. Components without extent (fewer distinct vectors than dimensions, constant dimensions) are left out;
    without two distinct vectors, or for an empty table, there is none. Repeated rows count once.
    """
    spark = vectors.sparkSession
    C.small_batches(spark, 10_000)
    raw = vectors.select(F.col(column).alias("embedding"))
    distinct, at = C.written(raw.mapInArrow(_points, "x array<int>").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("k")).first()
    if lengths is None or lengths.n < 2:
        C.dropped(spark, at)
        return None, 0.0, 0
    width, n = lengths.k, lengths.n
    own = distinct.where(F.size("x") == width)
    entries = own.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("long")).alias("s"))
    sums = np.zeros(width, np.int64)
    for r in entries.collect():  # one number for each dimension
        sums[r.i] = r.s
    values, vectors_ = jacobi(_scatter(own, width, lambda x: (n * x - sums) / n) / n)
    keep = (values > LEAST * max(values[0], 0)) & (np.arange(width) < components)
    model = Whitening(n, sums, vectors_[:, keep], values[keep], float(values.sum()))
    k, error = int(keep.sum()), 0.0
    if k:
        # Whitened vectors are centred as they come: their mean is the projection of zero. It is measured all the same.
        got = _scatter(own, width, lambda x: np.hstack([model.whiten(x), np.ones((len(x), 1))]) if k < width else model.whiten(x)) / n
        mean = got[:k, k] if k < width else np.zeros(k)
        error = float(np.abs(got[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    C.dropped(spark, at)
    return (model if k else None), error, width


def _deviation(x: np.ndarray, model: Whitening) -> np.ndarray:
    """The exact sum of (n * x - sums)^2 over dimensions; beyond 64 bits an error, never a wrong number."""
    if not len(x):
        return np.empty(0, np.int64)
    span = max(abs(int(s) - model.n * int(v)) for s, lo, hi in zip(model.sums, x.min(0), x.max(0), strict=True) for v in (lo, hi))
    if len(model.sums) * span * span < 1 << 63:
        return ((model.n * x - model.sums) ** 2).sum(axis=1)
    exact = [sum((model.n * int(v) - int(s)) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x]
    return np.array(exact, np.int64)  # raises OverflowError


def whitened(vectors: DataFrame, model: Whitening | None, width: int, error: float = 0.0, column: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Usable are the vectors that ``fit`` would count, repeated rows each by itself; a null vec_id stays. Other columns,
    whatever their names, do not matter. Without a model there are no rows.
    """
    C.small_batches(vectors.sparkSession, 10_000)

    def run(batches):
        for batch in batches:
            if model is None:
                continue
            at, lists = _grid(batch.column(1), width)
            x = _matrix(lists, width)
            k = len(model.eigenvalues)
            flat = lambda a, kind: pa.array(np.repeat(a, k), kind)
            shares = model.eigenvalues / model.trace
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(x) * k, model.n), pa.int64()), flat(_deviation(x, model), pa.int64()),
                    pa.array(model.whiten(x).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(x) * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    return slim.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str, components: int = 16) -> DataFrame:
    vectors = C.load(spark, sf_dir, "embeddings")
    model, error, width = fit(vectors, components=components)
    return whitened(vectors, model, width, error)
