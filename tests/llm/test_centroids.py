"""Centroid clustering against a plain k-means over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from freightspark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, Cluster string, planes int"


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    text = lambda i: "" if i is None else str(i)
    centre = [x for _, x in sorted(kept, key=lambda r: hashlib.sha256(f"1:{text(r[0])}".encode()).hexdigest())[:k]]

    def assign():
        each = [[sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centre] for _, x in kept]
        return [(d.index(min(d)), min(d)) for d in each]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centre)):
            own = [x for (_, x), (a, _) in zip(kept, at, strict=True) if a == c]
            if own:
                centre[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    inertia = [sum(d for a, d in at if a == c) for c in range(len(centre))]
    return sorted(((i, a, d, inertia[a], sum(inertia), digest[a]) for (i, _), (a, d) in zip(kept, at, strict=True)), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroids.clusters(df, **how).collect()), key=repr)


def test_planes_and_dot_products():
    r = np.random.default_rng(3)
    for low, high in ((0, 0), (0, 1), (-1, 0), (-64, 63), (-65, 64), (-centroids.LIMIT, centroids.LIMIT)):
        x = r.integers(low, high + 1, (40, 64))
        words = centroids.pack(x, centroids.n_planes(low, high))
        assert (centroids.unpack(words) == x).all()
        y = r.integers(-900, 901, (5, 64))
        assert (centroids.dots(words, centroids.pack(y, centroids.n_planes(-900, 900))) == x @ y.T).all()
        assert (centroids.dots(words, words) == (x * x).sum(axis=1)).all()


def test_clusters_match_plain_kmeans(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss((i % 5) / 3, 0.4) for _ in range(64)]) for i in range(300)]
    rows += [(300 + i, [0.25] * 64) for i in range(60)]  # many copies
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    r = random.Random(6)
    vector = lambda: [r.uniform(-1, 1) for _ in range(64)]
    odd = [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [None] + [0.1] * 63), (6, [math.nan] + [0.1] * 63), (7, [math.inf] + [0.1] * 63)]
    rows = odd + [(None, vector()), (-3, vector()), (9, [0.5] * 64), (9, [0.5] * 64), (10, [-0.0] * 64), (11, [100.0, *[-0.01] * 63])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, odd) == []
    assert run(spark, []) == []


def test_huge_components_are_cut_off(spark):
    got = run(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)], k=1)
    assert [r[0] for r in got] == [1, 2]
    assert all(0 <= r[2] < 1 << 62 for r in got)


@pytest.mark.parametrize("k", [1, 4])
def test_empty_clusters_stay(spark, k):
    rows = [(i, [0.5] * 64) for i in range(6)]
    assert run(spark, rows, k=k) == brute(rows, k=k)
