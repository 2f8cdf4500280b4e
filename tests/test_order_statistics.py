"""Order statistics of groups against sorted lists, whatever the ranges that a group falls into."""

import random

import pytest
from pyspark.sql import functions as F

from freightspark.functions import order_statistics as order
from freightspark.operators import catalog, evaluation, zones


def linear(values, share):
    v, place = sorted(values), (len(values) - 1) * share
    low = int(place)
    high = min(low + (place > low), len(v) - 1)
    return v[low] * (1 - (place - low)) + v[high] * (place - low)


@pytest.fixture(params=["1", "7", "40"])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_quantiles_of_hot_small_and_null_groups(spark, ranges):
    r = random.Random(8)
    rows = [("hot", r.randrange(50) / 4) for _ in range(900)] + [("wide", r.gauss(0, 100)) for _ in range(300)] + [("one", 7.0), (None, 1.0), (None, 4.0), ("same", 2.0), ("same", 2.0), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: (x.a, x.b, x.c, x.d) for x in order.quantiles(df, ["k"], F.col("v"), {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx([linear(v, s) for s in (0, 0.31, 0.5, 1)]) for k, v in want.items())


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    assert [tuple(x) for x in order.quantiles(df, [], F.col("v"), {"m": 0.5}).collect()] == [(2.0,)]
    assert order.quantiles(df.where("v > 9"), [], F.col("v"), {"m": 0.5}).count() == 0
    x = catalog.distribution(df.where("v is null"), "v").collect()
    assert [(r.n, r.least, r.median, r.mean) for r in x] == [(0, None, None, None)]


def test_distribution_keeps_null_groups_and_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "k string, v double")
    got = {r.k: (r.n, r.least, r.median, r.greatest, r["mean"]) for r in catalog.distribution(df, "v", ["k"]).collect()}
    assert got == {"a": (2, 1.0, 2.0, 3.0, 2.0), None: (1, 5.0, 5.0, 5.0, 5.0), "b": (0, None, None, None, None)}


def test_weighted_percentile(spark, ranges):
    r = random.Random(3)
    rows = [("x", r.randrange(40) / 2, r.randrange(-1, 9)) for _ in range(500)] + [("y", 1.0, 0), ("z", 3.0, 2), ("z", None, 5)]
    df = spark.createDataFrame(rows, "k string, v double, w long")
    got = {x.k: x.weighted_percentile for x in zones.weighted_percentile(df, ["k"], "v", "w", 0.9).collect()}

    def plain(k):
        own = sorted((v, w) for g, v, w in rows if g == k and v is not None and w > 0)
        total, upto = sum(w for _, w in own), 0
        for v, w in own:
            upto += w
            if upto >= 0.9 * total:
                return v

    assert got == {"x": plain("x"), "z": 3.0}


def test_no_group_is_ordered_in_one_task(spark, ranges):
    """A hot group's values lie in several ranges, and windows are over one range of it."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    placed = order.placed_values(df, ["k"], F.col("v"))
    most = placed.groupBy("part").count().agg(F.max("count")).first()[0]
    assert most <= 4000 if n == 1 else most < 3 * 4000 / n
    assert order.quantiles_of(placed, ["k"], {"m": 0.5}).first().m == linear([i * 7919 % 4001 for i in range(4000)], 0.5)


def test_metrics_medians_and_quartiles(spark):
    r = random.Random(4)
    p = spark.createDataFrame([(f"m{i % 5}", f"o{i}", "R", "v" if i % 3 else "w", r.uniform(50, 200), r.uniform(1, 9), r.uniform(50, 200), 0, 0.5) for i in range(300)], "shipment_month string, actual_origin_id string, destination_region string, variant string, actual_price double, qty double, predicted double, horizon int, auction_percent double")
    rows = p.collect()
    for x in evaluation.metrics(p, ["variant"]).collect():
        own = [q for q in rows if q.variant == x.variant]
        assert x.cells == len(own)
        assert x.mdape_pct == pytest.approx(linear([100 * abs(q.predicted - q.actual_price) / q.actual_price for q in own], 0.5))
        assert x.wape_pct == pytest.approx(100 * sum(q.qty * abs(q.predicted - q.actual_price) for q in own) / sum(q.qty * q.actual_price for q in own))
    quantities = sorted(q.qty for q in rows)
    assert list(evaluation.quartile_thresholds(p).first()) == [quantities[75], quantities[150], quantities[225]]


def test_narrowed_quantiles_equal_sorted_lists(spark, ranges):
    r = random.Random(9)
    inf = float("inf")
    nested = [2.0**-k for k in range(60)] + [1 + 2.0**-k for k in range(1, 52)]  # each split leaves most of them in one part
    rows = [("wide", r.gauss(0, 100)) for _ in range(400)] + [("tight", 50 + r.random() * 1e-9) for _ in range(300)] + [("hot", r.randrange(3) / 4) for _ in range(500)]
    rows += [("nested", v) for v in nested] + [("signs", v) for v in (-inf, -1e308, -5e-324, 0.0, 5e-324, 1e308, inf)] + [(None, 1.0), (None, 4.0), ("one", 7.0), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}
    got = {x.k: [x.a, x.b, x.c, x.d] for x in order.narrowed_quantiles(df, ["k"], F.col("v"), shares).collect()}
    want = {x.k: [x.a, x.b, x.c, x.d] for x in order.quantiles(df, ["k"], F.col("v"), shares).collect()}
    assert repr(got.pop("signs")) == repr(want.pop("signs")) and got.keys() == want.keys() and "empty" not in got
    assert got == want and got["tight"][2] == linear([v for k, v in rows if k == "tight"], 0.5)
    nan = spark.createDataFrame([("x", 1.0), ("x", float("nan")), ("x", 3.0)], "k string, v double")
    assert order.narrowed_quantiles(nan, ["k"], F.col("v"), {"m": 0.5}).first().m == 3.0
    assert order.narrowed_quantiles(nan.where("v < 0"), ["k"], F.col("v"), {"m": 0.5}).count() == 0
