"""Distances to clusters by blocks, against all pairs in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from freightspark.functions import distances


@pytest.mark.parametrize("block", [7, 1000])
def test_equals_all_pairs(spark, block):
    draw = random.Random(3)
    points = {(s, f"{s}{i}"): (draw.randrange(50) * 10.0, draw.random() * 500) for s, n in (("p", 40), ("q", 1), ("r", 9)) for i in range(n)}
    points[("p", "p1")] = points[("p", "p0")]
    label = {("p", k, i): i * k // 40 for k in (1, 5, 40) for i in range(40)} | {("q", 1, 0): 7} | {("r", 3, i): -i % 3 for i in range(9)}
    own = {(s, k, f"{s}{i}"): c for (s, k, i), c in label.items()}
    got = distances.cluster_distances(
        spark.createDataFrame([(*key, *at) for key, at in points.items()], "slice string, id string, x double, y double"),
        spark.createDataFrame([(*key, c) for key, c in own.items()], "slice string, k int, id string, cluster_id int"),
        block,
    )
    got = {(r.slice, r.k, r.id): (r.total, r.a, r.b) for r in got.collect()}
    assert set(got) == set(own)
    for (s, k, i), c in own.items():
        far: dict = {}
        for (t, l, j), d in own.items():
            if (t, l) == (s, k) and j != i:
                far.setdefault(d, []).append(math.dist(points[(s, i)], points[(s, j)]))
        inside, others = far.get(c, []), [sum(v) / len(v) for d, v in far.items() if d != c]
        total, a, b = got[(s, k, i)]
        assert total == pytest.approx(sum(inside))
        assert a == (pytest.approx(sum(inside) / len(inside)) if inside else None)
        assert b == (pytest.approx(min(others)) if others else None)


@pytest.mark.parametrize("nested", [True, False])
def test_many_clusters_and_partitions_that_are_not_nested(spark, nested):
    draw = random.Random(4)
    points = {f"p{i}": (draw.random() * 500, draw.random() * 500) for i in range(40)}
    label = {(k, i): int(i[1:]) // 2 if k == 2 else int(i[1:]) % 3 for k in ((2,) if nested else (2, 3)) for i in points}
    got = distances.cluster_distances(
        spark.createDataFrame([("s", i, *at) for i, at in points.items()], "slice string, id string, x double, y double"),
        spark.createDataFrame([("s", k, i, c) for (k, i), c in label.items()], "slice string, k int, id string, cluster_id int"),
        block=8, nested=nested, few=3,
    )
    got = {(r.k, r.id): (r.total, r.a, r.b) for r in got.collect()}
    assert set(got) == set(label)
    for (k, i), c in label.items():
        far: dict = {}
        for (m, j), d in label.items():
            if m == k and j != i:
                far.setdefault(d, []).append(math.dist(points[i], points[j]))
        inside = far.pop(c)
        assert got[(k, i)] == (pytest.approx(sum(inside)), pytest.approx(sum(inside) / len(inside)), pytest.approx(min(sum(v) / len(v) for v in far.values())))


def test_sums_of_a_bucket_are_let_go():
    """A task never holds a sum for each of a slice's clusters, however many there are."""
    n = 3000
    nest = {"k": np.full(n, 1), "fine": np.arange(n), "cluster": np.arange(n)}
    own = distances._Own("s", pa.array(["a"]), np.zeros(1), np.zeros(1), np.zeros(1, np.int64), nest)
    most = 0
    for bucket in range(30):
        at = np.arange(bucket, n, 30)
        own.meet(bucket, at.astype(float), np.zeros(len(at)), at)
        most = max(most, own.total.size)
    assert most == 100
    row = next(own.results()).to_pylist()[0]
    assert (row["total"], row["a"], row["b"]) == (0.0, None, 1.0)


@pytest.mark.parametrize("spread", [1.0, 1e-3, 0.0])
def test_far_boxes_meet_by_few_points(monkeypatch, spread):
    """Sums are those of all pairs, though only boxes near each other meet point by point."""
    draw = np.random.default_rng(6)
    n = 16000
    x, y = draw.random(n) * 1e5, spread * draw.random(n) * 1e5
    fine = np.sort(draw.integers(0, 9, n))
    nest = {"k": np.full(9, 1), "fine": np.arange(9), "cluster": np.arange(9)}
    pairs, each = [], distances._Own._each
    monkeypatch.setattr(distances, "LEAF", 400)
    monkeypatch.setattr(distances._Own, "_each", lambda own, rows, x, *rest: pairs.append((rows.stop - rows.start) * len(x)) or each(own, rows, x, *rest))
    own = distances._Own("s", pa.array([str(i) for i in range(n)]), x, y, fine, nest)
    own.meet(0, x, y, fine)
    assert sum(pairs) < 0.7 * n * n
    at = np.array(own.ids.to_pylist(), int)
    assert (own.x == x[at]).all() and (own.fine == fine[at]).all()
    some = np.arange(0, n, 37)
    d = np.hypot(own.x[some, None] - x, own.y[some, None] - y)
    want = np.stack([d[:, fine == c].sum(1) for c in range(9)], 1)
    assert own.total[some] == pytest.approx(want, rel=1e-9)
    facts = [r for b in own.facts() for r in b.to_pylist()]
    rows = {r["id"]: r for b in own.results() for r in b.to_pylist()}
    for f in facts:
        mine = {i: r for i, r in rows.items() if fine[int(i)] == f["cluster_id"]}
        assert (f["n"], f["near"], f["told"]) == (len(mine),) * 3
        assert f["total"] == min(r["total"] for r in mine.values()) == rows[f["id"]]["total"]
        assert f["s"] == pytest.approx(sum((r["b"] - r["a"]) / max(r["a"], r["b"]) for r in mine.values()))
