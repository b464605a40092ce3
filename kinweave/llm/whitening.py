"""Whitening of embeddings by the leading eigenvectors of their covariance.

Spark sums the fixed-point vectors, then their centred products; the covariance,
whose size is that of the dimension only, is decomposed on the driver:
Householder reflections make it tridiagonal, Sturm counts bracket its leading
eigenvalues by bisection, inverse iteration gives the eigenvectors, made
orthogonal again inside clusters.  The components are broadcast and every row is
projected where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.vectors import matrix, usable
from kinweave.session import ship_functions

ship_functions(__name__)

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of at least this magnitude are refused: their whole numbers would not be exact.
LARGEST = float(1 << 40)
COMPONENTS = 32
#: Eigenvalues closer than this share of the norm are one cluster.
CLUSTER = 1e-3
#: Eigenvalues up to this share of the largest are zero, as far as rounding can tell.
ZERO = 1e-13
#: Rows projected at a time.
TOGETHER = 4096


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflection vectors of a symmetric matrix, by Householder's method."""
    a = np.array(a, np.float64)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        rest = np.abs(v[1:]).max()
        if rest == 0:
            mirrors.append(np.zeros(0))
            continue
        v /= np.abs(v).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        mirrors.append(v)
        low = a[k + 1:, k + 1:]
        p = low @ v
        w = p - (v @ p) * v
        low -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = a[k + 1:, k]
        column -= 2 * v * (v @ column)
        a[k, k + 1:] = column
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each shift, the number of eigenvalues of the tridiagonal matrix below it: the negative pivots."""
    square = off * off
    least = np.finfo(float).tiny * max(1.0, square.max(initial=0.0)) * 4
    count = np.zeros(len(at), np.int64)
    pivot = np.full(len(at), np.inf)
    for i in range(len(diag)):
        pivot = diag[i] - at - (square[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The `count` largest eigenvalues, falling, each bisected until its bracket holds no further double."""
    n = len(diag)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.insert(off, 0, 0.0))
    norm = max(np.abs(diag - reach).max(), np.abs(diag + reach).max(), np.finfo(float).tiny)
    slack = 2 * n * np.finfo(float).eps * norm
    lo = np.full(count, (diag - reach).min() - slack)
    hi = np.full(count, (diag + reach).max() + slack)
    wanted = n - 1 - np.arange(count)  # so many eigenvalues are smaller
    while True:
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi) | (hi - lo < np.finfo(float).eps * norm / 4)).all():
            return lo + (hi - lo) / 2
        below = sturm_counts(diag, off, mid) > wanted
        hi = np.where(below, mid, hi)
        lo = np.where(below, lo, mid)


def _factors(diag: np.ndarray, off: np.ndarray, values: np.ndarray):
    """LU of T - value for all values at once, with row exchanges; upper band of width three, multipliers, exchanges."""
    n, k = len(diag), len(values)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    tiny = np.finfo(float).eps * norm
    u0, u1, u2 = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    times, swap = np.zeros((n, k)), np.zeros((n, k), bool)
    a, b = diag[0] - values, np.full(k, off[0] if n > 1 else 0.0)
    for i in range(n - 1):
        c, d = off[i], diag[i + 1] - values
        e = off[i + 1] if i + 2 < n else 0.0
        swap[i] = s = np.abs(a) < abs(c)
        u0[i] = np.where(s, c, np.where(np.abs(a) < tiny, np.copysign(tiny, a), a))
        u1[i] = np.where(s, d, b)
        u2[i] = np.where(s, e, 0.0)
        times[i] = m = np.where(s, a, c) / u0[i]
        a = np.where(s, b, d) - m * u1[i]
        b = np.where(s, 0.0, e) - m * u2[i]
    u0[n - 1] = np.where(np.abs(a) < tiny, np.copysign(tiny, a), a)
    return u0, u1, u2, times, swap


def _solve(factors, x: np.ndarray) -> np.ndarray:
    u0, u1, u2, times, swap = factors
    x = x.copy()
    n = len(x)
    for i in range(n - 1):
        here, below = np.where(swap[i], x[i + 1], x[i]), np.where(swap[i], x[i], x[i + 1])
        x[i], x[i + 1] = here, below - times[i] * here
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= u1[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= u2[i] * x[i + 2]
        x[i] /= u0[i]
        big = np.abs(x[i]) > 1e150
        if big.any():
            x[:, big] *= 1e-150
    return x


def eigenvectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Columns of unit eigenvectors for falling `values`, by inverse iteration; clusters are kept orthogonal."""
    n, k = len(diag), len(values)
    x = np.random.Generator(np.random.PCG64(7)).uniform(-1, 1, (n, k))
    norm = np.abs(diag).max() + 2 * np.abs(off).max(initial=0.0)
    starts = np.flatnonzero(np.concatenate([[True], values[:-1] - values[1:] > CLUSTER * norm]))
    factors = _factors(diag, off, values)
    for _ in range(rounds):
        x = _solve(factors, x)
        x /= np.linalg.norm(x, axis=0)
        for first, last in zip(starts, [*starts[1:], k]):
            for j in range(first + 1, last):
                for _ in range(2):
                    x[:, j] -= x[:, first:j] @ (x[:, first:j].T @ x[:, j])
                x[:, j] /= np.linalg.norm(x[:, j])
    return x


def leading_components(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit eigenvectors in columns, of a symmetric matrix."""
    count = min(count, len(a))
    scale = np.abs(a).max(initial=0.0)
    if scale == 0:
        return np.zeros(count), np.eye(len(a), count)
    diag, off, mirrors = tridiagonal(a / scale)
    values = leading_eigenvalues(diag, off, count)
    x = eigenvectors(diag, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        if len(v):
            x[k + 1:] -= 2 * np.outer(v, v @ x[k + 1:])
    return values * scale, x


@dataclass
class Whitening:
    """What `fit` learned of n vectors: sums per dimension, leading eigenvalues, components in columns, trace of the covariance."""

    dim: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float = float("nan")  # largest entry of the whitened covariance minus the identity

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """n * x - S of each vector, in whole numbers."""
        return self.n * whole(vectors) - self.sums

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n) @ (self.components / np.sqrt(self.values))


def whole(vectors: np.ndarray) -> np.ndarray:
    if np.abs(vectors).max(initial=0.0) >= LARGEST:
        raise ValueError(f"an entry of a vector is {LARGEST:.0f} or more")
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(at, TOGETHER)
            yield some, matrix(some.column(some.num_columns - 1), dim)


def _summed(partials: DataFrame) -> dict[tuple[int, int], float]:
    """(i, j) -> sum over the tasks of entry j of their row i."""
    cells = partials.select("i", F.posexplode("entries").alias("j", "entry")).groupBy("i", "j").agg(F.sum("entry").alias("entry"))
    return {(r["i"], r["j"]): r["entry"] for r in cells.collect()}  # no more than dimension squared


def _gram(rows: DataFrame, dim: int, width: int, of) -> np.ndarray:
    """Sum of y^T y over the rows, y = of(vectors) of `width` columns: one partial matrix per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, vectors in _batches(batches, dim):
            y = of(vectors)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "entries"])

    out = np.zeros((width, width))
    for (i, j), entry in _summed(rows.select("_kw_vec").mapInArrow(run, "i int, entries array<double>")).items():
        out[i, j] = entry
    return out


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all finite vectors of the most frequent length (of equal ones, the longest); None without any.

    Components whose eigenvalue is zero are left out: nothing can be divided by it.
    Repeated rows count as often as they stand there.
    """
    good = usable(rows, vec_col, F.lit(0).alias("_kw_none"))
    lengths = good.groupBy(F.size("_kw_vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    dim, n = most["dim"], most["n"]
    good = good.where(F.size("_kw_vec") == dim).select("_kw_vec")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, np.int64)
        for _, vectors in _batches(batches, dim):
            total += whole(vectors).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.int64()))], names=["i", "entries"])

    found = _summed(good.mapInArrow(add, "i int, entries array<long>"))
    model = Whitening(dim, n, np.array([found[0, j] for j in range(dim)], np.int64), np.zeros(0), np.zeros((dim, 0)), 0.0)
    covariance = _gram(good, dim, dim, lambda v: model.centred(v) / model.n) / n
    values, vectors = leading_components((covariance + covariance.T) / 2, components)
    kept = values > ZERO * max(values.max(initial=0.0), np.finfo(float).tiny / ZERO)
    model.values, model.components, model.trace = values[kept], vectors[:, kept], float(np.trace(covariance))
    width = len(model.values)

    def with_one(v: np.ndarray) -> np.ndarray:
        return np.column_stack([model.whiten(model.centred(v)), np.ones(len(v))])

    gram = _gram(good, dim, width + 1, with_one) / n
    mean = gram[:width, width]
    model.error = float(np.abs(gram[:width, :width] - np.outer(mean, mean) - np.eye(width)).max(initial=0.0))
    return model


def whiten(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, whitened array<double>, deviation decimal) of every row that has a finite vector of the model's length.

    `whitened` is the centred vector on each component, over the square root of
    its eigenvalue; `deviation` the exact sum of (n * x - S)^2.  Null ids and
    repeated rows are kept; other columns are left out; an empty table gives an
    empty one.
    """
    schema = f"{id_col} {dict(rows.dtypes)[id_col]}, whitened array<double>, deviation decimal(38,0)"
    good = usable(rows, vec_col, F.col(id_col))
    if model is None:
        return good.where("false").select(id_col, F.col("_kw_vec").alias("whitened"), F.lit(0).cast("decimal(38,0)").alias("deviation"))
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: executors need no copy of this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Whitening(**shared.value)
        for batch, vectors in _batches(batches, m.dim):
            y = m.centred(vectors)
            if np.square(y.astype(np.float64)).sum(axis=1).max(initial=0.0) < 2.0**62:
                deviation = pa.array(np.square(y).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([sum(int(v) ** 2 for v in row) for row in y], pa.decimal128(38, 0))
            out = m.whiten(y)
            offsets = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, out.ravel()), deviation], names=[id_col, "whitened", "deviation"])

    return good.where(F.size("_kw_vec") == model.dim).mapInArrow(run, schema)
