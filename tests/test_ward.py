"""Ward merging in tasks and in rounds over tables, and partitions of slices with and without a choice of K."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freightspark.operators import zones
from freightspark.plans import flows

EDGES, POINTS = "slice string, a string, b string, distance double", "slice string, id string, x double, y double, trip_count long, weighted_price double, weighted_rub_per_km double"


def merged(spark, xs: dict[str, tuple[float, float]], links: list[tuple[str, str]], **how) -> list:
    feats = spark.createDataFrame([(s, i, [x, y]) for s in ("s", "t") for i, (x, y) in xs.items()], "slice string, id string, f array<double>")
    edges = spark.createDataFrame([(s, *sorted(e), 1.0) for s in ("s", "t") for e in links], EDGES)
    return sorted(map(tuple, zones.ward_merges(feats, edges, **how).select("slice", "component", "a", "b", "height", "turn").collect()))


def test_merges_in_a_task_are_those_of_rounds_over_tables(spark):
    r = random.Random(8)
    # whole numbers, so that many costs are equal
    xs = {f"p{i:02d}": (float(r.randrange(9)), float(r.randrange(9))) for i in range(40)}
    links = list({tuple(sorted(r.sample(sorted(xs), 2))) for _ in range(60)})
    assert merged(spark, xs, links) == merged(spark, xs, links, few=12)


def test_a_chain_that_merges_one_pair_a_round(spark):
    xs = {f"p{i:03d}": (2.6**i, 0.0) for i in range(260)}
    names = sorted(xs)
    got = merged(spark, xs, list(zip(names, names[1:], strict=False)))
    assert [(r[2], r[3], r[5]) for r in sorted(got, key=lambda r: r[5]) if r[0] == "s"] == [("p000", names[i + 1], i) for i in range(259)]


def test_slices_without_a_choice_meet_no_pairs(spark, monkeypatch):
    pairs = [(f"q{i:02d}", 100.0 * i + j, 0.0) for i in range(22) for j in (0, 1)]
    line = [("q", 0.5 * i * i, 1.0) for i in range(6)]
    rows = [(s, f"{n}-{x}", x, y, 1, 1.0, 1.0) for s, ps in (("many", pairs), ("one", line)) for n, x, y in ps]
    points = spark.createDataFrame(rows, POINTS)
    many, one = ([r[1] for r in rows if r[0] == s] for s in ("many", "one"))
    edges = [("many", *sorted(many[i : i + 2]), 1.0) for i in range(0, 44, 2)] + [("one", *sorted(one[i : i + 2]), 1.0) for i in range(5)]
    seen, quality = [], zones.partition_quality
    monkeypatch.setattr(zones, "partition_quality", lambda p, a, **how: seen.extend(r[0] for r in a.select("slice").distinct().collect()) or quality(p, a, **how))
    got = flows.partition_modes(points, spark.createDataFrame(edges, EDGES), ("geography",))
    found = {r.slice: r.n for r in got.where("cluster_id >= 0").groupBy("slice").agg(F.countDistinct("cluster_id").alias("n")).collect()}
    assert seen == ["geography@one"] and found["many"] == 22 and 2 <= found["one"] <= 5
    # a table in which no slice has a choice
    got = flows.partition_modes(points.where("slice = 'many'"), spark.createDataFrame(edges, EDGES), ("geography",))
    assert got.where("cluster_id >= 0").select("cluster_id").distinct().count() == 22


def test_a_task_takes_texts_and_vectors_as_arrays():
    """Clusters of several slices, vectors of two and three numbers; only names that are merged become texts again."""
    rows = [("s", "c1", "c1", "c10", [0.0, 1.0], [2.0, 1.0]), ("s", "c1", "c10", "c9", [2.0, 1.0], [9.0, 1.0]), ("t", "c9", "c9", "x", [1.0, 2.0, 3.0], [1.0, 2.0, 5.0])]
    links = pa.table({"slice": [r[0] for r in rows], "component": [r[1] for r in rows], "a": [r[2] for r in rows], "b": [r[3] for r in rows], "fa": [r[4] for r in rows], "fb": [r[5] for r in rows], **{c: [1.0 if c[0] == "n" else 0.0] * 3 for c in ("na", "nb", "ha", "hb")}})
    names, a, b, f, _, _ = zones._ends(links)
    assert [n.to_pylist() for n in names] == [["s", "s", "s", "t", "t"], ["c1", "c10", "c9", "c9", "x"]]
    assert (a.tolist(), b.tolist(), f[4].tolist(), f[2].tolist()) == ([0, 1, 3], [1, 2, 4], [1.0, 2.0, 5.0], [9.0, 1.0, 0.0])
    got = sorted(tuple(r.values()) for x in zones._merge_rounds(links, 4) for r in x.to_pylist())
    assert got == [("s", "c1", "c1", "c10", 2.0, 4), ("s", "c1", "c1", "c9", pytest.approx(2 / 3 * 64), 5), ("t", "c9", "c9", "x", 2.0, 4)]
