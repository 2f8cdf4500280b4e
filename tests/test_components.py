"""Components of slices: named by the least id as text, worked out over numbers."""

import random

from freightspark.functions import components as stars
from freightspark.operators import graph


def test_components_by_numbers(spark, monkeypatch):
    seen = []

    def kept(edges, *how):
        seen.append({f.dataType.simpleString() for f in edges.schema})
        return stars.connected_components(edges, *how)

    monkeypatch.setattr(graph, "connected_components", kept)
    rows = [("s", "c10", "c9"), ("s", "c9", "c2"), ("s", "x", "y"), ("t", "c9", "c1"), ("t", "c9", "c9"), ("t", "lone", "lone")]
    got = graph.components(spark.createDataFrame(rows, "slice string, a string, b string")).collect()
    want = {("s", "c10"): "c10", ("s", "c9"): "c10", ("s", "c2"): "c10", ("s", "x"): "x", ("s", "y"): "x", ("t", "c9"): "c1", ("t", "c1"): "c1", ("t", "lone"): "lone"}
    assert {(r.slice, r.id): r.component for r in got} == want and len(got) == len(want)
    assert seen == [{"bigint"}]


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "slice string, a string, b string")).count() == 0


def test_a_slice_in_a_task_and_by_rounds(spark, monkeypatch):
    draw = random.Random(12)
    rows = [(s, f"c{draw.randrange(n)}", f"c{draw.randrange(n)}") for s, n in (("s", 90), ("t", 9), ("u", 400)) for _ in range(min(n, 200))]
    rows += [("chain", f"p{i:03d}", f"p{i + 1:03d}") for i in range(300)] + [("u", None, "c1"), ("u", "c2", None)]
    edges = spark.createDataFrame(rows, "slice string, a string, b string").repartition(3)
    rounds, stars_of = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e: rounds.append(e.count()) or stars_of(e))
    one, other, mixed = (sorted(map(tuple, graph.components(edges, few=few).select("slice", "id", "component").collect())) for few in (10_000, 0, 150))
    assert one == other == mixed
    # nothing is left for rounds where all slices are small
    assert rounds[0] == 0 and rounds[1] > rounds[2] > 0
    assert len({c for s, _, c in one if s == "chain"}) == 1 and len(one) == len({r[:2] for r in one})
