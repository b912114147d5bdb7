"""Whitening of embeddings: principal components by contour integrals of the covariance's resolvent (FEAST).

Spark makes the covariance: vectors are turned into whole numbers, each distinct one is counted once, and tasks return one
partial product of centred blocks each, which are added up. What reaches the driver is the covariance, whose size depends on the
dimension alone. There:

1. The matrix is brought to tridiagonal form once. Inertia counts (signs of the pivots of the shifted matrix) then tell how
   many eigenvalues lie above any shift, and bisection with them places the interval of the wanted components so that its lower
   end lies in a wide gap.
2. A rational filter, quadrature on the circle around the interval of complex shifted solves, projects a block of vectors
   onto the interval; Rayleigh-Ritz extracts the components, and both are repeated until the residuals are at rounding error.
3. The components found must be as many as the inertia counts say, so that none is missed; else the block is enlarged.

Every row is then projected where it lies, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import table, written

SCALE = 256
LARGEST = 2**40
NODES = 8
_BLOCK = 4096


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: ``floor(scale * c)`` of each component, for the rows that take part.

    Null and empty vectors and vectors with null or non-finite components do not; nor do those with a scaled component beyond
    ``LARGEST``, or of another length than the most common one (ties: the shorter). Repeated rows and null ids stay.
    """
    number = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.forall(number, lambda e: F.coalesce(F.abs(e) < F.lit(LARGEST / scale), F.lit(False)))
    fit = vectors.where((F.size("embedding") > 0) & usable)
    whole = fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda e: F.floor(e.cast("double") * scale)).cast("array<long>").alias("x"))
    length = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    return whole.where(F.size("x") == (length["d"] if length else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int, dtype: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(start, _BLOCK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def covariance(rows: DataFrame, column: str, width: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Covariance with divisor ``n`` of the arrays in ``column``, centred on ``mean`` before they are multiplied."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _matrices(batches, 0, width, float):
            x = x - mean
            total += x.T @ x
        if total.any():
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    summed = rows.select(column).mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    for r in summed.collect():  # width^2 / 2 cells
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"] / n
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of the symmetric ``a``, by reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = float(np.linalg.norm(v))
        if norm == 0:
            continue
        v[0] += math.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, beside: np.ndarray, shift: float) -> int:
    """Inertia count: how many eigenvalues of a tridiagonal matrix exceed ``shift``, by the signs of its pivots."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (float(beside[i - 1]) ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def interval(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """Ends of an interval that holds the ``wanted`` largest eigenvalues and perhaps some more, and how many it holds.

    The lower end lies in the widest gap below one of the next few eigenvalues, as far as bisection needs to know them.
    """
    n = len(v)
    diagonal, beside = tridiagonal(v)
    around = np.abs(np.concatenate([beside, [0.0]])) + np.abs(np.concatenate([[0.0], beside]))
    low, top = float((diagonal - around).min()), float((diagonal + around).max())
    spread = max(top - low, abs(top), 1e-300)
    low, top = low - 0.01 * spread, top + 0.01 * spread

    def eigenvalue(k: int) -> float:
        """The ``k``-th largest, to a small part of the spread."""
        a, b = low, top
        while b - a > 1e-9 * spread:
            m = (a + b) / 2
            a, b = (m, b) if above(diagonal, beside, m) >= k else (a, m)
        return (a + b) / 2

    most = min(n, wanted + 8)
    values = [eigenvalue(k) for k in range(wanted, min(n, most + 1) + 1)]
    gaps = [(x - y, wanted + i, (x + y) / 2) for i, (x, y) in enumerate(zip(values, values[1:]))]
    if most == n:
        gaps.append((values[-1] - low, n, low))
    _, count, end = max(gaps)
    while above(diagonal, beside, end) < count:  # equal eigenvalues on both sides: take them all
        count = above(diagonal, beside, end := end - 1e-8 * spread)
    return end, top, above(diagonal, beside, end)


def components(v: np.ndarray, wanted: int, nodes: int = NODES, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of the symmetric ``v``, falling, and their unit eigenvectors as columns."""
    n = len(v)
    wanted = min(wanted, n)
    size = float(np.abs(v).max())
    if size == 0:
        return np.zeros(wanted), np.eye(n)[:, :wanted]
    v = v / size
    low, high, count = interval(v, wanted)
    centre, radius = (low + high) / 2, (high - low) / 2
    at, w = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(1j * math.pi / 2 * (1 - at))  # the upper half of the circle; the lower one is its mirror image
    width = min(n, max(count + 4, count * 3 // 2))
    while True:
        block = np.linalg.qr(np.random.default_rng(0).normal(size=(n, width)))[0]
        for _ in range(most):
            projected = np.zeros_like(block)
            for weight, turn in zip(w, turns, strict=True):
                projected += weight / 2 * (radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(n) - v, block)).real
            basis = np.linalg.qr(projected)[0]
            values, turned = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ turned
            inside = np.flatnonzero((values > low) & (values < high))
            left = np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if len(inside) == count and left.max() <= 4e-15 * n:
                order = inside[::-1][:wanted]
                return values[order] * size, block[:, order]
        if width == n:
            raise ArithmeticError(f"{len(inside)} of {count} components found, residual {left.max() if len(left) else 0.0}")
        width = min(n, 2 * width)


def _deviation(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """``sum((n * x - s)^2)`` of each row, exact; null where it does not fit a long."""
    reach = max(n * int(np.abs(x).max(initial=0)) + max(map(abs, s)), 1)
    if reach * reach * len(s) < 2**63:
        d = x * n - np.array(s, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * n - np.array(s, object)
    return [t if t < 2**63 else None for t in (d * d).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, wanted: int = 4, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Takes ``vec_id`` and ``embedding`` of ``vectors`` and no other column; ``whole_vectors`` says which rows take part. All is
    fitted on each distinct whole-numbered vector once: ``n`` of them, their sums ``S`` and their covariance. Components are
    numbered by falling eigenvalue; those whose eigenvalue is no more than rounding error cannot be whitened and give no row,
    so that a table of one distinct vector, as an empty one, gives none.
    """
    spark = vectors.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = written(whole_vectors(vectors, scale), "whitening-whole")
    fit = written(whole.select("x").distinct(), "whitening-fit")
    cells = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not cells:
        return spark.createDataFrame([], out)
    n, s, d = cells[0]["n"], [r["s"] for r in cells], len(cells)
    mean = np.array(s) / n
    v = covariance(fit, "x", d, n, mean)
    values, vectors_ = components(v, wanted)
    good = values > np.finfo(float).eps * d * max(values.max(initial=0), np.abs(mean).max() ** 2 * np.finfo(float).eps)
    values, axes = values[good], vectors_[:, good]
    k = len(values)
    if not k:
        return spark.createDataFrame([], out)
    to = axes / np.sqrt(values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches, 0, d, float):
            yield pa.RecordBatch.from_arrays([pa.array(list((x - mean) @ to), pa.list_(pa.float64()))], ["w"])

    flat = written(fit.mapInArrow(projected, "w array<double>"), "whitening-fitted")
    middle = flat.agg(*[F.avg(F.col("w")[i]).alias(str(i)) for i in range(k)]).first()
    error = float(np.abs(covariance(flat, "w", k, n, np.array(list(middle))) - np.eye(k)).max())
    explained = (values / np.trace(v)).tolist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1, d, np.int64):
            white = (x - mean) @ to
            columns = [
                pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), k), pa.int64(), from_pandas=True) if not part.column(0).null_count
                else pa.array([i for i in part.column(0).to_pylist() for _ in range(k)], pa.int64()),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array([t for t in _deviation(x, n, s) for _ in range(k)], pa.int64()),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened", "explained"])

    told: list[Column] = [F.lit(n).cast("long").alias("n"), F.lit(error).alias("identity_error")]
    every = whole.mapInArrow(rows, "vec_id long, component int, deviation long, whitened double, explained double").select("*", *told)
    return every.select(*[f.split()[0] for f in out.split(", ")])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
