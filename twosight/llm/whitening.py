"""Operator 12: whitening of vectors along the leading eigenvectors of their covariance, found by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors as long whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows of an Arrow batch that are worked on at a time.
BLOCK = 4096


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of v, by Householder reflections."""
    a = v.astype(float).copy()
    n = len(a)
    for i in range(n - 2):
        x = a[i + 1 :, i].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[i + 1 :, i:] -= 2 * np.outer(x, x @ a[i + 1 :, i:])
        a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def eigenvalues_above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """The inertia of the tridiagonal matrix minus shift: the number of positive pivots, that is of eigenvalues above shift."""
    least = np.finfo(float).tiny + np.finfo(float).eps ** 2 * max(1e-300, np.abs(diagonal).max() + np.abs(off).max(initial=0))
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
    return count


def top_intervals(v: np.ndarray, wanted: int, spread: float = 8.0) -> list[tuple[float, float, int]]:
    """Intervals (low, high) of the spectrum, the highest first, that together hold the wanted largest eigenvalues, each
    with how many it holds by inertia.

    Their ends lie in gaps, at most half way to the next eigenvalue, found by bisection on inertia. Eigenvalues that can't be told apart in double
    precision stay together, so there may be more than wanted. Within an interval the eigenvalues differ by the factor
    spread at most, but for such ones, so that one circle tells those inside from those outside. Eigenvalues that are
    zero to within rounding are left out.
    """
    diagonal, off = tridiagonal(v)
    above = lambda x: eigenvalues_above(diagonal, off, x)
    reach = np.abs(diagonal) + np.r_[np.abs(off), 0] + np.r_[0, np.abs(off)]
    top = float(reach.max()) * (1 + 1e-12) + np.finfo(float).tiny
    wanted = min(wanted, len(v))

    def eigenvalue(place: int) -> float:
        """The place-th largest eigenvalue, to within rounding and from below."""
        low, high = -top * 1.01, top * 1.01
        while high - low > max(1e-15 * top, 1e-14 * abs(low)):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (mid, high) if above(mid) >= place else (low, mid)
        return low

    out, done, high = [], 0, 1.01 * top
    while done < wanted:
        first = eigenvalue(done + 1)
        if first <= 1e-13 * top:
            break
        last = min(wanted, max(done + 1, above(first / spread)))
        here = eigenvalue(last)
        while last < len(v) and here - (following := eigenvalue(last + 1)) <= 1e-11 * top:
            last, here = last + 1, following
        below = eigenvalue(last + 1) if last < len(v) else -top
        low = max((here + below) / 2, here - 0.1 * abs(here) - 1e-10 * top)
        out.append((low, min(high, first + 0.1 * abs(first) + 1e-10 * top), above(low) - done))
        done, high = above(low), low
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, points: int = 16, rounds: int = 60, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenpairs of the symmetric matrix v with eigenvalues between low and high, the largest first.

    Each round projects a block of vectors onto the interval's eigenspace: the resolvent is integrated along a circle
    around the interval by Gauss-Legendre quadrature (on its upper half, v being real), one solve of the shifted complex
    matrix per point. Rayleigh-Ritz within the block gives the eigenpairs, which start the next round, until all count
    pairs have residuals at the rounding level. Fewer pairs than inertia counted are an error.
    """
    n = len(v)
    size = min(n, count + max(6, count // 2))
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, size)))[0]
    nodes, weights = np.polynomial.legendre.leggauss(points)
    angles = np.pi / 2 * (1 - nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    scale = max(np.abs(v).max(), np.finfo(float).tiny)
    best = (np.inf, None, None)
    stale = 0
    for _ in range(rounds):
        projected = np.zeros_like(block)
        for angle, weight in zip(angles, weights, strict=True):
            turn = np.exp(1j * angle)
            solved = np.linalg.solve((centre + radius * turn) * np.eye(n) - v, block.astype(complex))
            projected += weight / 2 * np.real(radius * turn * solved)
        basis = np.linalg.qr(projected)[0]
        basis = np.linalg.qr(basis)[0]
        values, inner = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ inner[:, ::-1]
        values = values[::-1]
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) < count:
            continue
        values, vectors = values[inside[:count]], block[:, inside[:count]]
        residual = np.abs(v @ vectors - vectors * values).max() / scale
        stale = 0 if residual < 0.5 * best[0] else stale + 1
        if residual < best[0]:
            best = (residual, values, vectors)
        if best[0] < 1e-10 and stale >= 2:
            break
    if best[1] is None or best[0] > 1e-8:
        raise ArithmeticError(f"inertia counts {count} eigenvalues between {low} and {high}, contour integration has not found them all")
    return best[1], best[2]


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues and unit eigenvectors (columns), without those that are zero to within rounding."""
    if not v.size or v.trace() <= 0:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [feast(v, *interval) for interval in top_intervals(v, wanted)] or [(np.zeros(0), np.zeros((len(v), 0)))]
    values, vectors = np.concatenate([e for e, _ in found]), np.concatenate([x for _, x in found], axis=1)
    # Eigenvectors of different intervals are made orthogonal beyond their residuals, the leading ones unchanged.
    vectors, turned = np.linalg.qr(vectors)
    vectors = vectors * np.where(np.diag(turned) < 0, -1, 1)
    some = values[:wanted] > len(v) * 1e-14 * values[:1].sum()
    return values[:wanted][some], vectors[:, :wanted][:, some]


def usable(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The frame without null vectors and those with null or non-finite entries, and the length of the vectors.

    Vectors of another length than the commonest (of equally common ones the longer), and empty ones, are left out."""
    x = vectors[vector_col]
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = size["n"] if size else 0
    return rows.where(F.size(vector_col) == n), n


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + F.lit(SHIFT))


def _matrices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.column(at).slice(start, BLOCK)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def dimension_sums(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each dimension; a task sends one row per dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for x in _matrices(batches, 0):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total)], ["dim", "n", "s"])

    found = rows.select("x").mapInArrow(sums, "dim int, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out, n = np.zeros(dims, object), 0
    for row in found.collect():  # one row per dimension
        out[row["dim"]], n = row["s"], row["n"]
    return n, out


def covariance(rows: DataFrame, dims: int, n: int, s: np.ndarray) -> np.ndarray:
    """The covariance with divisor n: rows are centred first, then multiplied. A task sends one row per pair of dimensions."""
    near = np.array([int(v) // n for v in s], np.int64)
    rest = np.array([int(v) % n / n for v in s])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((dims, dims)), False
        for x in _matrices(batches, 0):
            centred = (x - near) - rest
            total, any_ = total + centred.T @ centred, True
        if any_:
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    found = rows.select("x").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((dims, dims))
    for row in found.collect():  # one row per pair of dimensions
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["s"] / n
    return out


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(1024 * entry) + 100000. Mean and covariance of x over all vectors come from two passes that
    send one row per dimension and per pair of dimensions from each task; the largest eigenvalues e of the covariance and
    their unit eigenvectors from contour integration, which inertia counts hold to completeness. whitened is the centred
    x projected on the component over sqrt(e), explained e over the trace, deviation the exact sum of (n * x - sum)^2,
    identity_error the largest entry of the whitened covariance minus the identity, measured on the written rows.

    Vectors that are null, empty, of another length than the commonest, or hold null or non-finite entries take no part.
    Repeated rows and ids are rows of their own, a null id is kept. Components without variance (to within rounding) and
    beyond the number of dimensions are not returned: equal vectors alone, one row or an empty table give no rows.
    A deviation beyond a long is an error. Of equal eigenvalues any orthonormal eigenvectors are taken, the same for all
    rows. Other columns are not returned.
    """
    spark = vectors.sparkSession
    rows, dims = usable(vectors, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not dims:
        return empty
    rows = rows.select(rows[id_col].alias("vec_id"), whole(rows[vector_col]).alias("x"))
    n, s = dimension_sums(rows, dims)
    v = covariance(rows, dims, n, s)
    values, axes = leading(v, components)
    if not len(values):
        return empty
    near = np.array([int(t) // n for t in s], np.int64)
    rest = np.array([int(t) % n / n for t in s])
    maps = axes / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [((x - near) - rest) @ maps for x in _matrices([batch], 1)]
            flat = pa.array(np.concatenate(out).ravel() if out else np.zeros(0))
            lists = pa.FixedSizeListArray.from_arrays(flat, maps.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["vec_id", "deviation", "w"])

    sums = F.array(*(F.lit(int(t)) for t in s))
    apart = F.aggregate(F.zip_with("x", sums, lambda x, t: (F.lit(n) * x - t) * (F.lit(n) * x - t)), F.lit(0).cast("long"), lambda a, b: a + b)
    made = written(rows.select("vec_id", "x", apart.alias("deviation")).mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>"))
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    measured = made.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, measured, strict=True))
    share = F.array(*(F.lit(float(e / v.trace())) for e in values))
    return made.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("_at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
