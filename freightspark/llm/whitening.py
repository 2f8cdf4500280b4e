"""Embedding whitening: leading principal components of integer vectors, from a distributed centred covariance.

Entries become integers floor(SCALE * c), and every distinct vector counts once in the fit. Tasks sum products of centred
vectors; only sums of d x d numbers meet on the driver, where the covariance is brought to tridiagonal form by Householder
reflections. Its leading eigenvalues come from bisection on Sturm counts, their vectors from inverse iteration, in which the
vectors of close eigenvalues are kept orthogonal to each other. Mean and components are broadcast to project every row.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out; entries beyond +-LIMIT count as
+-LIMIT; shorter vectors have zeros in the dimensions that they lack; a vector of more than MAX_DIMS entries is refused with an
error, as d x d numbers are summed; null and repeated ids are kept as they are; a component whose eigenvalue is nothing but rounding has null in
`whitened` (its explained share is still given, null where all vectors are equal); a deviation beyond a long is null; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.functions.shared import cut
from freightspark.llm.common import lean

SCALE, COMPONENTS = 256, 4
#: Entries are cut off here, so that sums over millions of vectors stay exact.
LIMIT = 1 << 40
#: Most entries of a vector; the covariance takes 8 * MAX_DIMS**2 bytes on the driver.
MAX_DIMS = 2048
#: Eigenvalues closer than this share of the matrix norm are one cluster.
CLOSE = 1e-3
EPS = float(np.finfo(np.float64).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix; a reflector v acts as I - 2 v v^T on the rows from k + 1 on."""
    a, n = a.copy(), len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = x[0] - 2 * v[0] * (v @ x)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each x: the negative pivots of T - x."""
    tiny = EPS * EPS * (1 + np.abs(d).max() + np.abs(e).max(initial=0))
    count, q = np.zeros(len(x), np.int64), np.ones(len(x))
    for k in range(len(d)):
        q = d[k] - x - (e[k - 1] ** 2 / q if k else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, m: int) -> np.ndarray:
    """The m greatest eigenvalues, falling, by bisection until no double lies between the bounds or 200 steps are done."""
    n = len(d)
    around = np.append(np.abs(e), 0) + np.append(0, np.abs(e))
    low, high = np.full(m, (d - around).min()), np.full(m, (d + around).max())
    pad = EPS * max(np.abs(low[0]), np.abs(high[0]), 1e-300) * n
    low, high = low - pad, high + pad
    wanted = n - 1 - np.arange(m)  # so many eigenvalues are below the k-th from above
    for _ in range(200):
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        below = sturm_counts(d, e, mid) > wanted
        low, high = np.where(below, low, mid), np.where(below, mid, high)
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """x with (T - shift) x = b by elimination with row exchanges; a vanishing pivot is taken as `floor`."""
    n = len(d)
    rows = np.zeros((n, 3))  # the pivot's row: itself and two to the right
    diag, up, rhs = d[0] - shift, (e[0] if n > 1 else 0.0), b.copy()
    for k in range(n - 1):
        below = np.array([e[k], d[k + 1] - shift, e[k + 1] if k + 2 < n else 0.0])
        mine = np.array([diag, up, 0.0])
        if abs(below[0]) > abs(mine[0]):
            mine, below = below, mine
            rhs[k], rhs[k + 1] = rhs[k + 1], rhs[k]
        if abs(mine[0]) < floor:
            mine[0] = floor
        f = below[0] / mine[0]
        rows[k] = mine
        diag, up = below[1] - f * mine[1], below[2] - f * mine[2]
        rhs[k + 1] -= f * rhs[k]
    rows[n - 1, 0] = diag if abs(diag) >= floor else floor
    x = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        x[k] = (rhs[k] - rows[k, 1] * x[k + 1] - rows[k, 2] * x[k + 2]) / rows[k, 0]
    return x[:n]


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: unit eigenvectors of the tridiagonal matrix for falling eigenvalues, by inverse iteration.

    A vector is made orthogonal to those of its cluster (eigenvalues within CLOSE of the norm of one another) in every step.
    """
    n = len(d)
    norm = max(np.abs(d).max() + 2 * np.abs(e).max(initial=0), 1e-300)
    noise = np.random.default_rng(1)
    out, start = np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            start = j
        x = noise.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                x -= out[:, start:j] @ (out[:, start:j].T @ x)
            x /= max(np.linalg.norm(x), 1e-300)
            x = _solve(d, e, value, x, EPS * norm)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[:, start:j] @ (out[:, start:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_components(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, columns of unit eigenvectors) of a symmetric matrix, the m greatest, falling; the largest entry of a vector is positive."""
    m, size = min(m, len(v)), float(np.abs(v).max())
    if not size:
        return np.zeros(m), np.eye(len(v))[:, :m]
    d, e, reflectors = tridiagonal(v / size)
    values = leading_eigenvalues(d, e, m)
    x = eigenvectors(d, e, values)
    for k in range(len(reflectors) - 1, -1, -1):
        x[k + 1 :] -= 2 * np.outer(reflectors[k], reflectors[k] @ x[k + 1 :])
    x /= np.linalg.norm(x, axis=0)
    x *= np.sign(x[np.abs(x).argmax(axis=0), np.arange(m)])
    return values * size, x


def to_integers(vectors: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """The rows whose vector counts, with `dims`, its entries, and `x`: these as integers in bytes, 1, 2, 4 or 8 an entry (the first byte says which).

    Trailing zeros are dropped, so vectors that are equal when padded with zeros have equal bytes.
    """
    own = [c for c in vectors.columns if c != vec_col]
    v = vectors.select(*own, F.col(vec_col).cast("array<double>").alias(vec_col))
    v = v.where(F.col(vec_col).isNotNull() & F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vec_col)
            ends = column.offsets.to_numpy()
            x = np.clip(np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)), -LIMIT, LIMIT).astype(np.int64)
            packed = []
            for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True):
                row = np.trim_zeros(x[a:b], "b")
                most = int(np.abs(row).max(initial=0))
                width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                packed.append(bytes([width]) + row.astype(f"<i{width}").tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(np.diff(ends)), pa.array(packed, pa.binary())], names=[*own, "dims", "x"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*own).schema]
    return v.mapInArrow(lean(run), ", ".join([*fields, "dims int", "x binary"]))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) integers of a batch's bytes; rows of equal length and width are read together."""
    out = np.zeros((len(column), dims), np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, lengths = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.diff(offsets)
    widths = data[offsets[:-1]]
    for length, width in np.unique(np.column_stack([lengths, widths]), axis=0).tolist():
        at = np.flatnonzero((lengths == length) & (widths == width))
        own = data[offsets[at][:, None] + np.arange(1, length)[None, :]]
        out[at, : (length - 1) // width] = own.view(f"<i{width}")
    return out


def _summed(rows: DataFrame, n: int, add: Callable[[np.ndarray, np.ndarray], None], dims: int, dtype: type) -> np.ndarray:
    """Sum over all rows of what `add` puts into an array of n numbers, a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype)
        for batch in batches:
            if batch.num_rows:
                add(total, _matrix(batch.column("x"), dims))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "total"])

    kind = "long" if dtype is np.int64 else "double"
    found = rows.select("x").mapInArrow(lean(run), f"at long, total {kind}").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(n, dtype)
    out[found.column("at").to_numpy()] = found.column("total").to_numpy()
    return out


def covariance(fit: DataFrame, n: int, dims: int, values: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Covariance (divisor n) of `width` values of each row, centred by their mean before they are multiplied."""

    def add_values(total: np.ndarray, x: np.ndarray) -> None:
        total += values(x).sum(axis=0)

    mean = _summed(fit, width, add_values, dims, np.float64) / n
    upper = np.triu_indices(width)

    def add_products(total: np.ndarray, x: np.ndarray) -> None:
        y = values(x) - mean
        total += (y.T @ y)[upper]

    out = np.zeros((width, width))
    out[upper] = _summed(fit, len(upper[0]), add_products, dims, np.float64) / n
    return np.triu(out) + np.triu(out, 1).T


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every row that counts and each leading component."""
    spark = vectors.sparkSession
    rows = to_integers(vectors.select(id_col, vec_col), vec_col, scale)
    fit = cut(rows.groupBy("x").agg(F.max("dims").alias("dims")), "distinct-vectors")
    n, dims = fit.agg(F.count("*"), F.max("dims")).first()
    dims = max(dims or 0, 1)
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS} are whitened")
    state = None
    if n:

        def add(total: np.ndarray, x: np.ndarray) -> None:
            total += x.sum(axis=0)

        sums = _summed(fit, dims, add, dims, np.int64)
        mean = sums / n
        v = covariance(fit, n, dims, lambda x: x - mean, dims)
        e, axes = leading_components(v, components)
        true = e > max(e[0], 0) * EPS * dims
        axes = axes / np.sqrt(np.where(true, e, 1))
        trace = float(np.trace(v))
        m = int(true.sum())
        error = float(np.abs(covariance(fit, n, dims, lambda x: (x - mean) @ axes[:, :m], m) - np.eye(m)).max()) if m else None
        state = (n, sums, mean, axes, true, [float(x) / trace if trace > 0 else None for x in e], error)
    known = spark.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, sums, mean, axes, true, explained, error = known.value
            x, m = _matrix(batch.column("x"), dims), len(true)
            deviation = _deviations(x, n, sums)
            z = np.where(true, (x - mean) @ axes, np.nan).ravel()
            size, each = len(x), np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * m, n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(z, mask=np.isnan(z)),
                    pa.array(explained * size, pa.float64()),
                    pa.array([error] * (size * m), pa.float64()),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = vectors.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; null beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most * most * len(sums) < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    big = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return [int(d) if d < 1 << 63 else None for d in big]
