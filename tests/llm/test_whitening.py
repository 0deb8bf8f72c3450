import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brasstide.llm import queries, whitening

DAY = "vec_id bigint, embedding array<float>"


def brute(rows, k=8):
    """Whitening of (key, vector) rows by a plain eigendecomposition; Python integers for what is exact."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * e - s) / n for e, s in zip(row, sums)] for row in x])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return {key: (sum((n * e - s) ** 2 for e, s in zip(row, sums)), c @ vectors / np.sqrt(values))
            for (key, _), row, c in zip(rows, x, centred)}, values / np.trace(v)


def check(got, rows, k=8):
    want, explained = brute(rows, k)
    assert len(got) == len(rows) * k
    sign = {}
    for r in got:
        deviation, z = want[r.vec_id]
        assert r.n == len(rows) and r.deviation == deviation
        if abs(z[r.component - 1]) > 1e-3:
            assert sign.setdefault(r.component, np.sign(z[r.component - 1] * r.whitened)) == np.sign(z[r.component - 1] * r.whitened)
        assert abs(abs(r.whitened) - abs(z[r.component - 1])) < 1e-8
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-9


def test_embeddings_match_a_plain_eigendecomposition(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, sf).collect(), rows)


def test_odd_vectors_are_left_out(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, math.nan, 2.0]), (53, [math.inf, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]),
           (56, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, DAY).withColumns({c: F.lit(c) for c in ("n", "d", "place", "value", "component", "whitened")})
    check(whitening.whitened(df).collect(), good, 3)


def test_ties_repeats_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 5.0])], DAY)
    got = whitening.whitened(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert all(r.n == 4 and abs(r.explained - 1) < 1e-12 for r in got)
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id = 1")).count() == 0  # no variance
    assert whitening.whitened(df.where("vec_id = 2")).count() == 0
    assert whitening.whitened(df.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0


def test_deviation_is_exact_beyond_a_double_and_null_beyond_64_bits():
    x = np.array([[3_000_000_001, -5], [7, 11]], dtype=np.int64)
    assert whitening._deviations(x, 2, [3_000_000_008, 6]) == [
        (2 * 3_000_000_001 - 3_000_000_008) ** 2 + (-10 - 6) ** 2 if (2 * 3_000_000_001 - 3_000_000_008) ** 2 + 256 < 2 ** 63 else None,
        None if (14 - 3_000_000_008) ** 2 + (22 - 6) ** 2 >= 2 ** 63 else (14 - 3_000_000_008) ** 2 + 256]


@pytest.mark.parametrize("values", [
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5], [5] * 4 + [1] * 8, [1e6, 1, 1e-6] + [1e-9] * 9, [1 + 1e-7 * i for i in range(60)], [3, 2],
    [4, 4, 4], list(range(1, 90))])
def test_eigenpairs_of_known_spectra(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    for k in (1, 3, 8, 40):
        got, vectors = whitening.top_eigenpairs(matrix, k)
        want = sorted(values, reverse=True)[:k]
        scale = max(values)
        assert len(got) == sum(v > d * 2.3e-16 * sum(values) for v in want)
        assert np.allclose(got, want[:len(got)], rtol=0, atol=1e-13 * scale * d)
        assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-12)
        assert np.abs(matrix @ vectors - vectors * got).max() < 1e-11 * scale


def test_inertia_counts_and_gaps():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(30, 30)))[0]
    matrix = q @ np.diag(np.arange(1.0, 31.0)) @ q.T
    bands = whitening.tridiagonal((matrix + matrix.T) / 2)
    assert [whitening.above(bands, s) for s in (0.5, 10.5, 29.5, 30.5)] == [30, 20, 1, 0]
    with pytest.raises(ArithmeticError):
        whitening.contour(matrix, 20.5, 25.5, 6)
