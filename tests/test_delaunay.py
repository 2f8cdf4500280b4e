"""The local empty-circle test against all third points, and its work on one large slice."""

import math
import random

import pytest
from pyspark.sql import functions as F

from freightspark.operators import graph


def brute(points, pairs):
    """Pairs of which some circle holds no other point, by all points of the slice."""
    out = set()
    for s, a, b, dist in pairs:
        own = {i: (x, y) for t, i, x, y in points if t == s}
        (ax, ay), (bx, by) = own[a], own[b]
        low, high, ok = -math.inf, math.inf, True
        for i, (x, y) in own.items():
            if i in (a, b):
                continue
            mx, my = x - (ax + bx) / 2, y - (ay + by) / 2
            d, w = (mx * (ay - by) + my * (bx - ax)) / dist, mx * mx + my * my - dist * dist / 4
            if abs(d) <= 1e-9 * dist:
                ok &= w >= -1e-9 * dist * dist
            elif d > 0:
                high = min(high, w / (2 * d))
            else:
                low = max(low, w / (2 * d))
        if ok and low <= high + 1e-9 * dist:
            out.add((s, a, b))
    return out


def frames(spark, points, radius):
    p = spark.createDataFrame(points, "slice string, id string, x double, y double")
    pairs = graph.pairs_within(p.withColumn("r", F.lit(float(radius))), "r")
    return p, pairs


def clustered(seed):
    r = random.Random(seed)
    points = [("uniform", f"u{i}", r.uniform(0, 100), r.uniform(0, 100)) for i in range(120)]
    for k in range(4):
        cx, cy = r.uniform(-500, 500), r.uniform(-500, 500)
        points += [("towns", f"t{k}-{i}", r.gauss(cx, 3), r.gauss(cy, 3)) for i in range(25)]
    points += [("line", f"l{i}", 10.0 * i, 5.0) for i in range(8)]
    points += [("arc", f"a{i}", 40 * math.cos(i / 9), 40 * math.sin(i / 9)) for i in range(12)] + [("arc", "far", 9000.0, 0.0)]
    points += [("two", "p", 0.0, 0.0), ("two", "q", 3.0, 4.0), ("alone", "z", 1.0, 1.0)]
    return points + [("square", n, x, y) for n, x, y in (("a", 0.0, 0.0), ("b", 6.0, 0.0), ("c", 6.0, 6.0), ("d", 0.0, 6.0))]


@pytest.mark.parametrize("radius", [12, 60])
def test_edges_equal_brute_force(spark, radius):
    points = clustered(radius)
    p, pairs = frames(spark, points, radius)
    got = {(r.slice, r.a, r.b) for r in graph.delaunay_edges(p, pairs).collect()}
    rows = [(r.slice, r.a, r.b, r.distance) for r in pairs.collect()]
    assert got == brute(points, rows)
    assert len(got) < len(rows)


def test_no_pairs(spark):
    p, pairs = frames(spark, [("s", "a", 0.0, 0.0), ("s", "b", 900.0, 0.0)], 5)
    assert graph.delaunay_edges(p, pairs).count() == 0


def test_work_on_one_large_slice_follows_its_points(spark, monkeypatch):
    """20 000 points in one slice: third points met per point, against 5 000 points of the same density."""
    whole, met = graph.third_points, []

    def counted(pairs, points):
        out = whole(pairs, points)
        met[-1] += out.count()
        return out

    monkeypatch.setattr(graph, "third_points", counted)
    found = {}
    for n in (5000, 20_000):
        r, side = random.Random(n), math.sqrt(n)
        points = [("s", f"p{i}", r.uniform(0, side), r.uniform(0, side)) for i in range(n)]
        p, pairs = frames(spark, points, 1.6)
        met.append(0)
        found[n] = graph.delaunay_edges(p.repartition(8), pairs).count()
    assert met[1] < 6 * met[0] and met[1] < 1000 * 20_000
    assert 2 * 20_000 < found[20_000] < 3 * 20_000


def test_pairs_on_the_rim_settle_at_once(spark, monkeypatch):
    """A pair with an empty side meets no more points for it: only thin corners need wider cells."""
    whole, met = graph.third_points, []
    monkeypatch.setattr(graph, "third_points", lambda pairs, points: met.append(pairs.count()) or whole(pairs, points))
    r = random.Random(2)
    points = [("s", f"p{i}", r.uniform(0, 40), r.uniform(0, 40)) for i in range(1500)]
    p, pairs = frames(spark, points, 3.0)
    got = {(x.slice, x.a, x.b) for x in graph.delaunay_edges(p, pairs).collect()}
    assert got == brute(points, [(x.slice, x.a, x.b, x.distance) for x in pairs.collect()])
    # before, all pairs of the rim went on to the second and third test
    assert met[1] < 0.02 * met[0] and met[2] < 0.001 * met[0]
