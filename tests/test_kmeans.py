"""Batched k-means: properties of the fits, agreement of labels, and the leaderboard's Pareto mark."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from freightspark.operators import kmeans

SCHEMA = "slice string, id string, x double, y double, trip_count long, weighted_price double, weighted_rub_per_km double"


def blobs(spark, slices=("a", "b"), n=60, centres=((0, 0), (9000, 0), (0, 9000))):
    r = random.Random(11)
    rows = [(s, f"{s}{i}", cx + r.gauss(0, 300), cy + r.gauss(0, 300), r.randrange(9), 1.0, 1.0) for s in slices for i in range(n) for cx, cy in [centres[i % len(centres)]]]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_blobs_are_found_in_all_slices_at_once(spark):
    rows, points = blobs(spark)
    found = kmeans.fits(points, (2, 3), seeds=(1, 2), starts=4).collect()
    assert {(r.slice, r.k, r.weights, r.seed) for r in found} == set(itertools.product("ab", (2, 3), kmeans.WEIGHTS, (1, 2)))
    assert len(found) == 16 * 60
    where = {r[1]: int(r[1][1:]) % 3 for r in rows}
    for key in itertools.product("ab", kmeans.WEIGHTS, (1, 2)):
        own = [r for r in found if (r.slice, r.weights, r.seed) == key and r.k == 3]
        assert len({(where[r.id], r.cluster_id) for r in own}) == 3
        assert len({r.cost for r in own}) == 1


@pytest.mark.parametrize("weights", kmeans.WEIGHTS)
def test_points_are_with_their_nearest_mean(spark, weights):
    r = random.Random(5)
    rows = [("s", f"p{i}", r.uniform(0, 1000), r.uniform(0, 1000), r.randrange(4), 1.0, 1.0) for i in range(150)]
    found = kmeans.fits(spark.createDataFrame(rows, SCHEMA), (4, 7), (weights,), (3,), 1).collect()
    place = {i: (x, y, 1 if weights == "none" else t) for _, i, x, y, t, _, _ in rows}
    for k in (4, 7):
        own = [f for f in found if f.k == k]
        means = {}
        for c in {f.cluster_id for f in own}:
            in_it = [place[f.id] for f in own if f.cluster_id == c]
            if total := sum(p[2] for p in in_it):
                means[c] = tuple(sum(p[j] * p[2] for p in in_it) / total for j in (0, 1))
        gap = lambda f, c: math.dist(place[f.id][:2], means[c])
        assert all(gap(f, f.cluster_id) <= min(gap(f, c) for c in means) + 1e-3 for f in own if f.cluster_id in means)
        cost = sum(place[f.id][2] * gap(f, f.cluster_id) ** 2 for f in own if f.cluster_id in means)
        assert own[0].cost == pytest.approx(cost)
    check = kmeans.fit_check(spark.createDataFrame(rows, SCHEMA), kmeans.fits(spark.createDataFrame(rows, SCHEMA), (4,), (weights,), (3,), 1)).collect()
    assert [(c.points, c.not_nearest) for c in check] == [(150, 0)]


def test_few_points_and_no_weight(spark):
    rows = [("two", "a", 0.0, 0.0, 0, 1.0, 1.0), ("two", "b", 5.0, 0.0, 0, 1.0, 1.0), ("one", "c", 1.0, 1.0, 3, 1.0, 1.0)]
    found = kmeans.fits(spark.createDataFrame(rows, SCHEMA), (1, 2), seeds=(1,), starts=2).collect()
    assert {(r.slice, r.k, r.weights) for r in found} == {("two", 1, "none"), ("two", 2, "none"), ("one", 1, "none"), ("one", 1, "shipment_count")}
    with pytest.raises(ValueError):
        kmeans.fits(spark.createDataFrame(rows, SCHEMA), (0,))
    with pytest.raises(ValueError):
        kmeans.fits(spark.createDataFrame(rows, SCHEMA), (2,), ("price",))


def plain_ari(a, b):
    both = lambda n: n * (n - 1) / 2
    count = lambda v: [v.count(x) for x in set(v)]
    same, x, y = (sum(map(both, count(v))) for v in (list(zip(a, b, strict=True)), a, b))
    chance = x * y / both(len(a))
    return 1.0 if (x + y) / 2 == chance else (same - chance) / ((x + y) / 2 - chance)


def test_adjusted_rand(spark):
    r = random.Random(2)
    cases = {"random": ([r.randrange(3) for _ in range(50)], [r.randrange(4) for _ in range(50)]), "same": ([0, 0, 1, 1], [5, 5, 2, 2]), "one": ([0, 0, 0], [1, 1, 1]), "apart": ([0, 1, 2], [2, 1, 0]), "cross": ([0, 0, 1, 1], [0, 1, 0, 1])}
    rows = [(k, i, a, b) for k, (x, y) in cases.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = {x.k: x.ari for x in kmeans.adjusted_rand(spark.createDataFrame(rows, "k string, i int, a int, b int"), ["k"], "a", "b").collect()}
    assert got == {k: pytest.approx(plain_ari(*v)) for k, v in cases.items()}


def test_leaderboard(spark):
    _, points = blobs(spark)
    found, board = kmeans.sweep(points, (2, 3, 4), seeds=(1, 2, 3), starts=3)
    rows, labels = board.collect(), found.collect()
    assert {(r.slice, r.k, r.weights) for r in rows} == set(itertools.product("ab", (2, 3, 4), kmeans.WEIGHTS))
    for r in rows:
        own = {s: [x.cluster_id for x in sorted((x for x in labels if (x.slice, x.k, x.weights, x.seed) == (r.slice, r.k, r.weights, s)), key=lambda x: x.id)] for s in (1, 2, 3)}
        ari = [plain_ari(own[a], own[b]) for a, b in ((1, 2), (1, 3), (2, 3))]
        assert r.stability_runs == 3
        assert (r.stability_mean_ari, r.stability_min_ari) == (pytest.approx(sum(ari) / 3), pytest.approx(min(ari)))
        assert r.weight_sensitivity_ari is not None and r.point_coverage_pct == 100
    best = lambda r: (r.stability_mean_ari, r.silhouette, -r.weighted_p95_radius_km, -r.shipment_share_cv)
    for r in rows:
        beaten = any(all(x >= y for x, y in zip(best(o), best(r), strict=True)) and best(o) != best(r) for o in rows if o.slice == r.slice)
        assert r.pareto_shortlist != beaten
    three = [r for r in rows if r.k == 3]
    assert all(r.silhouette > 0.8 and r.stability_min_ari == pytest.approx(1) and r.weighted_p95_radius_km < 2 for r in three)


def test_a_block_goes_through_all_runs_without_a_row_for_each_point():
    """Sums of a block come out by run and centre; ties go to the smaller number, points of no weight add nothing."""
    runs = [{"k": 2, "seed": 1, "start": 0, "centres": [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}]}, {"k": 1, "seed": 1, "start": 0, "centres": [{"x": 1.0, "y": 0.0}]}]
    row = {"slice": "s", "weights": "none", "ids": ["a", "b", "c"], "x": [0.0, 2.0, 5.0], "y": [0.0, 0.0, 0.0], "w": [1.0, 2.0, 0.0], "runs": runs}
    got = [r for b in kmeans._centre_sums(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()]
    assert [(r["k"], r["c"], r["sx"], r["sw"], r["cost"]) for r in got] == [(2, 0, 4.0, 3.0, 8.0), (2, 1, 0.0, 0.0, 0.0), (1, 0, 4.0, 3.0, 3.0)]


def uneven(spark):
    r = random.Random(9)
    # few places, so that many points and distances are equal; trips of which one outweighs all others
    rows = [("a", f"a{i}", float(r.randrange(40)), float(r.randrange(40)), 10**6 if i == 7 else r.randrange(4), 1.0, 1.0) for i in range(700)] + [("b", f"b{i}", r.gauss(0, 9), r.gauss(0, 9), 1, 1.0, 1.0) for i in range(90)] + [("c", f"c{i}", 3.0, 3.0, 0, 1.0, 1.0) for i in range(5)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_rounds_in_a_task_are_those_of_rounds_over_tables(spark):
    _, points = uneven(spark)
    how = {"ks": (2, 5), "seeds": (1, 2), "starts": 2}
    one, other = ({(r.slice, r.k, r.weights, r.seed): r for r in kmeans.best_runs(points, **how, few=few)[1].collect()} for few in (kmeans.FEW_POINTS, 100))
    assert one.keys() == other.keys() and len(one) == 20
    for key, r in one.items():
        assert (r.start, r.rounds, r.cost) == (other[key].start, other[key].rounds, pytest.approx(other[key].cost, abs=1e-6))
        assert [tuple(c) for c in r.centres] == [pytest.approx(tuple(c)) for c in other[key].centres]


def test_boxes_add_up_as_points_do():
    r = np.random.default_rng(4)
    for x, y in ((r.random(3000), r.random(3000)), (r.integers(0, 9, 3000) * 1.0, r.integers(0, 9, 3000) * 1.0), (np.ones(5), np.ones(5))):
        w = r.integers(0, 3, len(x)) * 1.0
        boxes, whole = kmeans._Boxes(x, y, w), 0
        for centres in (r.random((6, 2)), r.integers(0, 9, (4, 2)) * 1.0, np.zeros((3, 2))):
            _, at = kmeans.nearest(x, y, centres)
            want = np.stack([np.bincount(at, v, len(centres)) for v in (w * x, w * y, w)], 1)
            assert boxes.centre_sums(centres) == pytest.approx(want)


def test_draws_are_the_least_keys_of_all_points(spark, monkeypatch):
    """Also where one point has nearly all the weight, so that few keys are as low as even weights would make them."""
    _, points = uneven(spark)
    p = kmeans.weighted_points(points)
    runs = spark.createDataFrame([(s, k, w, 3, 0) for s in "abc" for k in (2, 9) for w in kmeans.WEIGHTS], "slice string, k int, weights string, seed int, start int")
    found = []
    for dealt, likely in ((10_000, 16), (50, 16), (50, 1e-9)):
        monkeypatch.setattr(kmeans, "DEALT", dealt)
        monkeypatch.setattr(kmeans, "LIKELY", likely)
        found.append(sorted((r.slice, r.k, r.weights, [tuple(c) for c in r.centres]) for r in kmeans.first_centres(p, runs).collect()))
    # five points without weight in c, none of them for nine centres
    assert found[0] == found[1] == found[2] and len(found[0]) == 9


def test_leaderboard_from_blocks_is_that_of_all_points(spark, monkeypatch):
    rows, points = uneven(spark)
    monkeypatch.setattr(kmeans, "REACHES", 16)
    found, board = kmeans.sweep(points, (2, 3), seeds=(1, 2), starts=1)
    place = {r[:2]: r[2:5] for r in rows}
    labels = {}
    for f in found.collect():
        labels.setdefault((f.slice, f.k, f.weights, f.seed), {})[f.id] = f.cluster_id
    board = {(r.slice, r.k, r.weights): r for r in board.collect()}
    assert len(board) == 10
    for (s, k, w), r in board.items():
        own = labels[s, k, w, 1]
        p = {i: place[s, i] for i in own}
        far = {i: {} for i in p}
        for i, j in itertools.permutations(p, 2):
            far[i].setdefault(own[j], []).append(math.dist(p[i][:2], p[j][:2]))
        silhouettes, near = [], {}
        for i in p:
            inside, others = far[i].get(own[i], []), [sum(v) / len(v) for c, v in far[i].items() if c != own[i]]
            a, b = sum(inside) / max(len(inside), 1), min(others, default=None)
            near.setdefault(own[i], []).append((sum(inside), i))
            if b is not None or a == 0:
                silhouettes.append(0.0 if not inside or max(a, b or 0) == 0 else (b - a) / max(a, b))
        assert r.silhouette == (pytest.approx(sum(silhouettes) / len(silhouettes)) if silhouettes else None)
        # equal totals of equal places differ in their last digits only
        medoid = {c: p[min(v, key=lambda q: (round(q[0], 6), q[1]))[1]] for c, v in near.items()}
        d = sorted((math.dist(p[i][:2], medoid[own[i]][:2]), p[i][2]) for i in p)
        n, trips = len(d), sum(t for _, t in d)
        at = (n - 1) * 0.95
        low, high = d[math.floor(at)][0], d[math.ceil(at)][0]
        upto, tail = 0, None
        for x, t in d:
            upto += t
            if t and tail is None and upto >= 0.95 * trips:
                tail = x
        assert (r.mean_radius_km, r.p95_radius_km, r.max_radius_km) == pytest.approx((sum(x for x, _ in d) / n / 1000, (low + (high - low) * (at - math.floor(at))) / 1000, d[-1][0] / 1000))
        assert r.weighted_p95_radius_km == (None if tail is None else pytest.approx(tail / 1000))
        assert r.weighted_mean_radius_km == (pytest.approx(sum(x * t for x, t in d) / trips / 1000) if trips else None)
        sizes = [len(v) for v in near.values()]
        shares = [sum(p[i][2] for _, i in v) / trips if trips else 0.0 for v in near.values()]
        assert (r.clusters, r.min_cluster_points, r.max_cluster_points) == (len(sizes), min(sizes), max(sizes))
        assert (r.min_shipment_share, r.max_shipment_share) == pytest.approx((min(shares), max(shares)))
        assert (r.point_coverage_pct, r.shipment_coverage_pct) == (100, 100 if trips else 0)
        ids = sorted(p)
        assert r.stability_mean_ari == pytest.approx(plain_ari([own[i] for i in ids], [labels[s, k, w, 2][i] for i in ids]))
        if s != "c":
            assert r.weight_sensitivity_ari == pytest.approx(plain_ari(*[[labels[s, k, v, 1][i] for i in ids] for v in kmeans.WEIGHTS]))
