"""Whitening of embeddings: exact integer statistics, eigenpairs by contour integration, inertia counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of at least this size have no exact integer form; their vectors are left out, as non-finite ones are.
REACH = 2.0 ** 42
COMPONENTS = 8
#: Quadrature nodes on the upper half of a contour, and rounds of subspace iteration at most.
NODES, ROUNDS = 16, 60
#: Eigenvalues in one contour at most, where the spectrum has a gap to cut at.
INSIDE = 24
#: Eigenvalues closer than this share of the largest are not parted by a contour's edge.
GAP = 1e-10


@dataclass
class Whitening:
    """n vectors with entry sums S (exact); `values` falling, `vectors` one unit column a component."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty, of finite entries without nulls, and of the commonest length.

    Ties between lengths go to the longer. Other columns pass through.
    """
    odd = F.exists(column, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) >= REACH))
    good = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(odd, F.lit(True)))
    common = (good.groupBy(F.size(column).alias("d")).count()
              .agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()[0])
    return good.where(F.size(column) == (common or 0))


def _entries(column) -> np.ndarray:
    """Integer vectors of an Arrow list column, one per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat) + SHIFT).astype(np.int64).reshape(len(column), -1)


def _parts(step, kind: str):
    """A task's batches folded by `step` into (n, array), handed out entry by entry at the end."""
    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                more = step(_entries(batch.column(0)))
                n, total = n + batch.num_rows, more if total is None else total + more
        if n:
            flat = total.reshape(-1)
            place = np.arange(len(flat) + 1) - 1  # -1: the number of rows
            values = np.concatenate([np.array([n], dtype=flat.dtype), flat])
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(values)], names=["place", "value"])
    return fold, f"place bigint, value {kind}"


def _summed(vectors: DataFrame, column: str, step, kind: str, exact: str) -> tuple[int, list]:
    """(rows, sums of the steps' entries) over all vectors: partial sums a task, added up by place."""
    task, schema = _parts(step, kind)
    rows = (vectors.select(column).mapInArrow(task, schema).groupBy("place")
            .agg(F.sum(F.col("value").cast(exact)).alias("total")).orderBy("place").collect())  # a row for each entry of one matrix
    return (int(rows[0].total), [r.total for r in rows[1:]]) if rows else (0, [])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n with whole and fractional parts of S / n taken apart, so that large means cost no digits."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size > 0:
            v /= size
            a[k + 1:] -= 2 * np.outer(v, v @ a[k + 1:])
            a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(bands: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Inertia: how many eigenvalues exceed `shift`, the positive pivots of L D L' of T - shift."""
    diagonal, beside = bands
    least = np.finfo(float).tiny ** 0.5
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
    return count


def _edge(bands, k: int, low: float, high: float) -> float:
    """The k-th largest eigenvalue to the last digits, by bisection on inertia."""
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if above(bands, middle) >= k else (low, middle)
    return high


def intervals(matrix: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count): intervals that hold the k largest eigenvalues, cut in gaps, highest first.

    Where the k-th eigenvalue has equals, all of them come along.
    """
    d, bands = len(matrix), tridiagonal(matrix)
    reach = np.abs(matrix).sum(axis=1).max()
    found = [_edge(bands, i + 1, -1.01 * reach, 1.01 * reach) for i in range(k)]
    while len(found) < d:
        beyond = _edge(bands, len(found) + 1, -1.01 * reach, 1.01 * reach)
        if len(found) >= k and found[-1] - beyond > GAP * reach:
            break
        found.append(beyond)
    else:
        beyond = found[-1] - max(abs(found[-1]), reach) * 0.1
    edges = [found[0] + max(GAP * reach, (found[0] - found[-1]) * 0.1), *found, beyond]
    cuts, start = [edges[0]], 0
    while start < len(found):
        room = min(start + INSIDE, len(found))
        best = room if room == len(found) else max(range(start + 1, room + 1), key=lambda i: found[i - 1] - found[i])
        while best < len(found) and found[best - 1] - found[best] <= GAP * reach:
            best += 1
        cuts.append((found[best - 1] + (found[best] if best < len(found) else beyond)) / 2)
        start = best
    out = [(low, high, above(bands, low) - above(bands, high)) for high, low in zip(cuts, cuts[1:])]
    assert sum(c for *_, c in out) == len(found)
    return out


def contour(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs in (low, high): FEAST, subspace iteration with a contour's projector.

    Each round solves (z - V) X = Y at complex nodes z of a circle through both ends (upper half;
    the lower is its conjugate), adds up the projection by Gauss quadrature, and takes eigenpairs of
    V within its span (Rayleigh-Ritz). It ends when residuals no longer fall and reach rounding
    size. Fewer or more values inside than `count`, the inertia, is an error: none goes unseen.
    """
    d = len(matrix)
    width = min(d, count + max(8, count // 2))
    y = np.random.default_rng(11).standard_normal((d, width))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (nodes + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    scale, before = np.abs(matrix).sum(axis=1).max(), np.inf
    eye = np.eye(d)
    for _ in range(ROUNDS):
        q = sum(w * (radius * t * np.linalg.solve((centre + radius * t) * eye - matrix, y)).real for t, w in zip(turn, weights))
        basis = np.linalg.qr(np.linalg.qr(q)[0])[0]
        small = basis.T @ matrix @ basis
        values, inner = np.linalg.eigh((small + small.T) / 2)
        y = basis @ inner
        inside = (values > low) & (values < high)
        if inside.sum() > count:
            # Directions left to rounding may have a Rayleigh quotient in between, but they are no eigenvectors.
            inside &= np.linalg.norm(matrix @ y - y * values, axis=0) <= 1e-8 * scale
        if inside.sum() == count:
            left = np.linalg.norm(matrix @ y[:, inside] - y[:, inside] * values[inside], axis=0).max() if count else 0.0
            if left <= 1e-11 * scale and left > 0.5 * before or left <= 4e-16 * scale:
                return values[inside][::-1], y[:, inside][:, ::-1]
            before = min(before, left)
    raise ArithmeticError(f"{count} eigenvalues between {low} and {high}, {int(inside.sum())} found, residual {before:.2g}")


def top_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns; zero ones left out."""
    d = len(matrix)
    if not d or np.trace(matrix) <= 0:
        return np.zeros(0), np.zeros((d, 0))
    found = [contour(matrix, *each) for each in intervals(matrix, min(k, d))]
    span = np.linalg.qr(np.concatenate([v for _, v in found], axis=1))[0]
    inner = span.T @ matrix @ span
    values, turn = np.linalg.eigh((inner + inner.T) / 2)  # contours' spans meet at right angles, to the last digits
    values, vectors = values[::-1][:k], (span @ turn)[:, ::-1][:, :k]
    real = values > d * np.finfo(float).eps * np.trace(matrix)
    return values[real], vectors[:, real]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Statistics of all `vectors` (see `usable`) and the covariance's leading eigenpairs.

    Two scans: integer sums, exact; then products of vectors centred by them, added up per task
    and by entry. What comes to the driver is one d x d matrix, whatever the number of vectors.
    """
    n, sums = _summed(vectors, column, lambda x: x.sum(axis=0), "bigint", "decimal(38,0)")
    sums = [int(s) for s in sums]
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)

    def products(x):
        c = _centred(x, n, sums)
        return c.T @ c
    _, flat = _summed(vectors, column, products, "double", "double")
    matrix = np.array(flat).reshape(len(sums), len(sums)) / n
    values, found = top_eigenpairs((matrix + matrix.T) / 2, components)
    return Whitening(n, sums, values, found, float(np.trace(matrix)))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' own covariance minus the identity, by two more
    scans: their sums, then products centred by them. Null without components."""
    k, n, sums = len(model.values), model.n, model.sums
    if not k:
        return None
    turn = model.vectors / np.sqrt(model.values)
    _, total = _summed(vectors, column, lambda x: (_centred(x, n, sums) @ turn).sum(axis=0), "double", "double")
    mean = np.array(total) / n

    def products(x):
        z = _centred(x, n, sums) @ turn - mean
        return z.T @ z
    _, flat = _summed(vectors, column, products, "double", "double")
    return float(np.abs(np.array(flat).reshape(k, k) / n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exact; None beyond 64 bits."""
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=object)
    near = x - centre  # n x - S = n (x - S // n) - S % n
    size = n * (np.abs(near).max(axis=1).astype(float) + 1)
    fits = size ** 2 * x.shape[1] < 2.0 ** 62
    out: list[int | None] = [None] * len(x)
    if fits.any():
        v = near[fits] * np.int64(n) - rest.astype(np.int64)
        for i, s in zip(np.flatnonzero(fits).tolist(), (v * v).sum(axis=1).tolist()):
            out[i] = s
    for i in np.flatnonzero(~fits).tolist():
        exact = sum((n * e - r) ** 2 for e, r in zip(near[i].tolist(), rest.tolist()))
        out[i] = exact if exact < 2 ** 63 else None
    return out


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per vector and component.

    Each entry c counts as the integer floor(1024 c) + 100000. Vectors that are null, empty, hold a
    null or an entry that is not finite (or 2^42 and more), or are not of the commonest length are
    left out. Repeated rows count and come out as often as they stand, null keys as they are.
    Components number from 1 by falling eigenvalue; those of zero variance are left out, so equal
    vectors give no rows, nor does an empty table. `deviation` is exact, null beyond 64 bits.
    """
    good = usable(vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("embedding")))
    model = fit(good, "embedding", components)
    error = identity_error(good, model)
    k, n, sums = len(model.values), model.n, model.sums
    turn = model.vectors / np.sqrt(model.values) if k else model.vectors
    share = model.values / model.trace if k else model.values
    kind = vectors.schema[key].dataType.simpleString()

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = _entries(batch.column(1))
            z = _centred(x, n, sums) @ turn
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(rows)), pa.array(z.reshape(-1)),
                 pa.array(np.tile(share, len(x)))],
                names=["vec_id", "component", "deviation", "whitened", "explained"])

    out = good.select("vec_id", "embedding").mapInArrow(
        project, f"vec_id {kind}, component int, deviation bigint, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained",
                      F.lit(error).cast("double").alias("identity_error"))
