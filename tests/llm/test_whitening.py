"""Whitening against dense eigenvectors, and the eigensolver on matrices with close, equal and vanishing eigenvalues."""

import math
import random

import numpy as np
import pytest

from freightspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, dims int, component int"


def matrices():
    r = np.random.default_rng(7)
    b = r.standard_normal((200, 30))
    q, _ = np.linalg.qr(r.standard_normal((40, 40)))
    return {
        "random": b.T @ b,
        "equal": np.eye(6),
        "pairs": q @ np.diag([5.0, 5, 5, 3, 3, *np.linspace(1, 0, 35)]) @ q.T,
        "close": q @ np.diag([1, 1 - 1e-12, 1 - 2e-12, 0.5, *np.zeros(36)]) @ q.T,
        "zero": np.zeros((3, 3)),
        "one": np.array([[2.0]]),
        "two": np.array([[2.0, 1], [1, 2]]),
        "rank one": np.outer(np.arange(5.0), np.arange(5.0)),
        "split": np.diag([1.0, 4, 2, 4]),
        "tiny": 1e-200 * (b.T @ b),
        "huge": 1e150 * (b.T @ b),
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_leading_components(name):
    a = matrices()[name]
    a = (a + a.T) / 2
    e, v = whitening.leading_components(a, 4)
    size, m = max(np.abs(a).max(), 1e-300) * len(a), min(4, len(a))
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1][:m]).max() <= 1e-14 * size
    assert np.abs(v.T @ v - np.eye(m)).max() < 1e-12
    assert np.abs(a @ v - v * e).max() <= 1e-13 * size


def test_sturm_counts():
    r = np.random.default_rng(2)
    a = r.standard_normal((25, 25))
    d, e, _ = whitening.tridiagonal(a + a.T)
    x = np.linspace(-12, 12, 50)
    assert (whitening.sturm_counts(d, e, x) == [(np.linalg.eigvalsh(a + a.T) < y).sum() for y in x]).all()


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    return whitening.whiten(df, **how).toPandas()


def check(found, rows, components=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) + 0 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    wide = max(len(x) for _, x in kept)
    kept = [(i, tuple(x + [0] * (wide - len(x)))) for i, x in kept]
    fit = sorted(set(x for _, x in kept))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float)
    centred = x - np.array(s) / n
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    m = min(components, wide)
    assert len(found) == len(kept) * m
    assert (found.n == n).all() and sorted(found.component.unique()) == list(range(1, m + 1))
    deviation = sorted((i, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))) for i, v in kept for _ in range(m))
    assert sorted(zip(found.vec_id, found.deviation, strict=True)) == deviation
    true = int((values[:m] > values[0] * 1e-12).sum())
    assert found[found.component <= true].whitened.notna().all() and found[found.component > true].whitened.isna().all()
    for c in range(1, m + 1):
        own = found[found.component == c]
        assert np.allclose(own.explained, values[c - 1] / values.sum(), atol=1e-12)
    assert found.identity_error.max() < 1e-9
    # on the fit list the whitened components have mean 0 and covariance 1
    z = {}
    for i, c, w in zip(found.vec_id, found.component, found.whitened, strict=True):
        z.setdefault(i, {})[c] = w
    by_vector = {v: [z[i][c] for c in range(1, true + 1)] for i, v in kept}
    fitted = np.array([by_vector[v] for v in fit])
    assert np.abs(fitted.mean(axis=0)).max() < 1e-9
    assert np.abs(fitted.T @ fitted / n - np.eye(true)).max() < 1e-9
    projected = centred.T @ fitted / n  # = eigenvector * sqrt(eigenvalue)
    assert np.allclose(np.abs(projected).sum(axis=0) > 0, True)
    assert np.allclose((projected**2).sum(axis=0), values[:true], rtol=1e-9)


def test_against_dense_eigenvectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(12) * np.linspace(2, 0.3, 12) + 0.5).tolist()) for i in range(200)]
    rows += [(900 + i, rows[i % 3][1]) for i in range(80)]  # copies count once
    check(run(spark, rows), rows)


def test_odd_vectors(spark):
    r = random.Random(3)
    good = [(i, [r.uniform(-2, 2) for _ in range(5)]) for i in range(30)]
    odd = [(50, None), (51, [None, 1.0]), (52, [math.nan]), (53, [1.0, -math.inf])]
    short = [(60, []), (61, [0.5]), (62, [0.5, 0.0, 0.0, 0.0, 0.0]), (63, [-0.001, -0.0])]
    check(run(spark, good + odd + short), good + odd + short)
    assert run(spark, odd).empty and run(spark, []).empty


def test_few_dimensions_and_ranks(spark):
    check(run(spark, [(1, [1.0]), (2, [2.0]), (2, [2.0])]), [(1, [1.0]), (2, [2.0]), (2, [2.0])])
    line = [(i, [0.5 * i, 1.0 * i, -1.0 * i]) for i in range(9)]
    check(run(spark, line), line)
    same = run(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    assert same.whitened.isna().all() and same.explained.isna().all() and (same.n == 1).all() and (same.deviation == 0).all()


def test_deviation_beyond_a_long_is_null(spark):
    got = run(spark, [(1, [4e9, 1.0]), (2, [-4e9, 2.0]), (3, [0.0, 3.0])])
    assert got.deviation.isna().any() and got.whitened.notna().any()
    assert whitening._deviations(np.array([[3, 4]]), 5, np.array([1, 2])) == [14**2 + 18**2]
    assert whitening._deviations(np.array([[1 << 31, 0]]), 2, np.array([0, 1])) == [None]
    assert whitening._deviations(np.array([[1 << 30, 0], [1 << 31, 0]]), 2, np.array([0, 1])) == [(1 << 62) + 1, None]


def test_long_vectors_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0] * (whitening.MAX_DIMS + 1))])
