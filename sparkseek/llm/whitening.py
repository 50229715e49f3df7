"""Whitening of embeddings: principal components of a distributed covariance, scaled to unit variance.

Spark computes exact sums and, in a second pass, the covariance of centred vectors, cell by cell. Its matrix, whose size
depends on the dimension alone, is solved here: Householder reflections make it tridiagonal, bisection on Sturm counts gives
the leading eigenvalues, inverse iteration their vectors, each made orthogonal to those of near eigenvalues, and the
reflections turn them back. A third pass projects all rows on the broadcast components, a fourth checks the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm.common import fresh

_EPS = np.finfo(np.float64).eps
_CHUNK = 4096


class Fit(NamedTuple):
    """n vectors of dimension len(sums); sums of each component, exact; the covariance's trace; the leading eigenvalues,
    falling, and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def whole_numbers(vector: Column, factor: int = 64, offset: int = 1_000_000) -> Column:
    """floor(factor * x) + offset of all components as longs; null where the vector is null or has a null or non-finite
    component, or one whose number would not fit 64 bits."""
    scaled = F.transform(vector, lambda c: c.cast("double") * factor)
    sound = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**62)))
    return F.when(sound, F.transform(scaled, lambda c: F.floor(c).cast("long") + offset))


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors (the k-th acts on rows k + 1 and below) of a symmetric matrix."""
    a = matrix.copy()
    size = len(a)
    reflections = []
    for k in range(size - 2):
        x = a[k + 1 :, k].copy()
        norm = float(np.linalg.norm(x))
        if norm > 0:
            x[0] += norm if x[0] >= 0 else -norm
            x /= np.linalg.norm(x)
            block = a[k + 1 :, k + 1 :]
            p = block @ x
            q = p - (x @ p) * x
            block -= 2 * (np.outer(x, q) + np.outer(q, x))
            a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        reflections.append(x)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflections


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a symmetric tridiagonal matrix, falling, by bisection: the number of negative pivots of
    T - x is the number of eigenvalues below x."""
    size = len(diagonal)
    square = np.append(0.0, off**2)
    reach = np.append(0.0, np.abs(off)) + np.append(np.abs(off), 0.0)
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    tiny = max(abs(low), abs(high), 1e-300) * _EPS * 1e-3
    wanted = size - 1 - np.arange(min(k, size))  # so many eigenvalues are smaller
    a, b = np.full(len(wanted), low - tiny), np.full(len(wanted), high + tiny)
    for _ in range(128):
        x = (a + b) / 2
        count, pivot = np.zeros(len(x), np.int64), np.ones(len(x))
        for d, s in zip(diagonal, square, strict=True):
            pivot = d - x - s / pivot
            pivot[np.abs(pivot) < tiny] = -tiny
            count += pivot < 0
        below = count <= wanted
        a, b = np.where(below, x, a), np.where(below, b, x)
        if ((b - a) <= 2 * _EPS * np.maximum(np.abs(a), np.abs(b)) + tiny).all():
            break
    return (a + b) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """Gaussian elimination with row exchanges of T - shift, as a function that solves for a right side."""
    size = len(diagonal)
    u = np.zeros((size, 3))
    steps = []
    row = [diagonal[0] - shift, off[0] if size > 1 else 0.0, 0.0]
    for i in range(size - 1):
        below = [off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < size else 0.0]
        swap = abs(below[0]) > abs(row[0])
        if swap:
            row, below = below, row
        if abs(row[0]) < tiny:
            row[0] = tiny
        f = below[0] / row[0]
        u[i] = row
        steps.append((swap, f))
        row = [below[1] - f * row[1], below[2] - f * row[2], 0.0]
    if abs(row[0]) < tiny:
        row[0] = tiny
    u[-1] = row

    def solve(right: np.ndarray) -> np.ndarray:
        y = right.copy()
        for i, (swap, f) in enumerate(steps):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= f * y[i]
        x = np.zeros(size + 2)
        for i in reversed(range(size)):
            x[i] = (y[i] - u[i, 1] * x[i + 1] - u[i, 2] * x[i + 2]) / u[i, 0]
        return x[:size]

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, by inverse iteration. Within a cluster, eigenvalues nearer to their neighbour than a
    thousandth of the norm, shifts are kept apart and every iterate is made orthogonal to the vectors before it."""
    size = len(diagonal)
    norm = float(np.max(np.abs(diagonal) + np.append(0.0, np.abs(off)) + np.append(np.abs(off), 0.0), initial=0.0)) or 1.0
    out = np.zeros((size, len(values)))
    random = np.random.default_rng(20)
    cluster, shift = 0, 0.0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        shift = value if k == cluster else min(value, shift - 4 * _EPS * norm)
        solve = _solve(diagonal, off, shift, _EPS * norm)
        x = random.standard_normal(size)
        for _ in range(6):
            for _ in range(2):
                x -= out[:, cluster:k] @ (out[:, cluster:k].T @ x)
            x /= np.linalg.norm(x)
            x = solve(x)
            x /= np.abs(x).max()  # a near singular system gives huge entries
        for _ in range(2):
            x -= out[:, cluster:k] @ (out[:, cluster:k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, the largest entry of each
    positive."""
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading(diagonal, off, k)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for at in reversed(range(len(reflections))):
        x = reflections[at]
        vectors[at + 1 :] -= 2 * np.outer(x, x @ vectors[at + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def _matrices(batches, column: str, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(at, _CHUNK)
            values = part.column(column).flatten().to_numpy()
            yield part, values.reshape(part.num_rows, size if size is not None else len(values) // max(1, part.num_rows))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as 64-bit integers where they fit, else as Python integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums), 0)
    if 2 * most < 2**63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus the mean, as doubles: the difference is exact before it is divided."""
    return (deviations(x, n, sums) / n).astype(np.float64)


def _gram(vectors: DataFrame, centre, dimension: int, size: int) -> np.ndarray:
    """The sum of y y^T over all rows, y = centre(x) of length size: each task sums its own, Spark the tasks' cells. Of the
    matrix, whose size does not depend on the rows, the upper half comes to the driver."""
    upper = np.triu_indices(size)

    def cells(batches):
        total = np.zeros((size, size))
        for _, x in _matrices(batches, "x", dimension):
            y = centre(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array((upper[0] * size + upper[1]).astype(np.int64)), pa.array(total[upper])], names=["cell", "part"])

    rows = vectors.select("x").mapInArrow(cells, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("total")).toPandas()
    out = np.zeros(size * size)
    out[rows["cell"].to_numpy()] = rows["total"].to_numpy()
    out = out.reshape(size, size)
    return out + np.triu(out, 1).T


def fit(vectors: DataFrame, k: int = 32) -> Fit | None:
    """Of a table with a column x of longs, all of one length: exact sums, and k eigenpairs of the covariance (divisor n).
    None where there are no rows."""

    def add(batches):
        n, total = 0, None
        for part, x in _matrices(batches, "x"):
            n += part.num_rows
            exact = x if int(np.abs(x).max(initial=0)) * max(1, len(x)) < 2**62 else x.astype(object)
            one = exact.sum(axis=0).astype(object)
            total = one if total is None else total + one
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total])], names=["place", "n", "part"]
            )

    sums = vectors.select("x").mapInArrow(add, "place int, n long, part string")
    sums = sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()  # a row a dimension
    if not sums:
        return None
    n, totals = sums[0]["n"], [int(r["total"]) for r in sums]
    covariance = _gram(vectors, lambda x: _centred(x, n, totals), len(totals), len(totals)) / n
    values, directions = eigen(covariance, k)
    trace = float(np.trace(covariance))
    sound = values > 1e-12 * max(trace, 1e-300)
    return Fit(n, totals, trace, values[sound], directions[:, sound])


def whiten(vectors: DataFrame, keep: list | None = None, vector_col: str = "embedding", k: int = 32, factor: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Rows of vectors with a sound vector, their columns (or those in keep), and

    n: vectors in the fit, which are all of these rows; deviation: the sum of (n * x - S)^2 over the dimensions, exact, null
    beyond 64 bits; whitened: array of doubles, (x - S / n) on each component over the root of its eigenvalue; explained:
    array of doubles, eigenvalues over the trace; identity_error: the largest entry of whitened's covariance minus the
    identity, by size. x are the whole numbers of a vector, S their sums.

    Components are k at most, or as many as there are dimensions; those without variance (eigenvalue up to 1e-12 of the
    trace) can't be scaled and are left out, so equal vectors have none. Vectors that are null, hold null or non-finite
    components, or components beyond 2**62 / factor, are dropped; so are those of another length than most have (ties: the
    longer) and those of no length. Repeated rows count each. Without rows the result is empty. Columns that have
    these names already get theirs with underscores."""
    keep = [c for c in keep or vectors.columns if c in vectors.columns]
    kept = vectors.select(*keep)
    names = fresh(kept, "n", "deviation", "whitened", "explained", "identity_error")
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.DoubleType()), T.DoubleType())
    schema = T.StructType([*kept.schema.fields, *(T.StructField(*x) for x in zip(names, kinds, strict=True))])
    numbered = vectors.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), whole_numbers(F.col(vector_col), factor, offset).alias("x"))
    numbered = numbered.where(F.size("x") > 0)
    lengths = numbered.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    size = lengths[0]["size"]
    numbered = numbered.where(F.size("x") == size)
    found = fit(numbered, k)
    n, sums = found.n, found.sums
    scaled = found.vectors / np.sqrt(found.values)
    explained = found.values / found.trace if len(found.values) else found.values
    told = vectors.sparkSession.sparkContext.broadcast((sums, scaled))

    def on_components(x: np.ndarray) -> np.ndarray:
        sums, scaled = told.value
        return _centred(x, n, sums) @ scaled

    # projections of centred vectors are centred
    count = scaled.shape[1]
    error = float(np.abs(_gram(numbered, on_components, size, count) / n - np.eye(count)).max()) if count else 0.0

    def project(batches):
        sums, scaled = told.value
        for part, x in _matrices(batches, "x", size):
            apart = deviations(x, n, sums)
            most = max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0))))
            square = (apart**2).sum(axis=1) if size * most**2 < 2**63 else (apart.astype(object) ** 2).sum(axis=1)
            square = pa.array([int(s) if s < 2**63 else None for s in square], pa.int64())
            white = (apart / n).astype(np.float64) @ scaled
            rows = len(white)
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(f"k{i}") for i in range(len(keep))), pa.array(np.full(rows, n, np.int64)), square,
                    pa.ListArray.from_arrays(ends, pa.array(white.ravel())), pa.ListArray.from_arrays(ends, pa.array(np.tile(explained, rows))),
                    pa.array(np.full(rows, error)),
                ],
                names=[*keep, *names],
            )

    return numbered.mapInArrow(project, schema)
