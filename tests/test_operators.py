"""Hand-checked cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from freightspark.functions import scalars
from freightspark.functions.components import connected_components
from freightspark.operators import economics, evaluation, graph, zones
from freightspark.plans import flows

OBS = "origin_fias string, destination_fias string, destination_name string, destination_region string, period_id string, period_type string, price_type string, vehicle_type string, tonnage_id string, price double, trip_count long, route_length double"


def obs(spark, triples, origin="o"):
    return spark.createDataFrame([(o if isinstance(o := t[3] if len(t) > 3 else origin, str) else origin, "d", "Town", "R", "202601", "current", "spot", "tent", "20", *[float(t[0]) if t[0] is not None else None, t[1], float(t[2]) if t[2] is not None else None]) for t in triples], OBS)


def one(df):
    return df.collect()[0]


def test_weighted_price(spark):
    r = one(economics.destination_economics(obs(spark, [(1000, 2, 100), (2000, 3, 100), (4000, 5, 100)]), ["destination_region"]))
    assert (r.trip_count, r.weighted_price, r.weighted_rub_per_km) == (10, 2800, 28)


def test_own_denominators(spark):
    r = one(economics.destination_economics(obs(spark, [(1000, 2, 100), (2000, 1, 200), (3000, 3, None), (None, 4, 400), (9000, 0, 900)]), ["destination_region"]))
    assert r.trip_count == 10
    assert (r.length_trips, r.price_trips, r.rate_trips) == (7, 6, 3)
    assert r.weighted_route_length == pytest.approx(2000 / 7)
    assert r.weighted_price == pytest.approx(13000 / 6)
    assert r.weighted_rub_per_km == pytest.approx(10)


def test_null_weights(spark):
    r = one(economics.destination_economics(obs(spark, [(1000, None, 100), (2000, 0, 100), (3000, -2, 100)]), ["destination_region"]))
    assert (r.weighted_price, r.weighted_route_length, r.weighted_rub_per_km, r.trip_count) == (None, None, None, 0)


def test_origin_union(spark):
    r = one(economics.destination_economics(obs(spark, [(1000, 10, 100, "a"), (6000, 30, 300, "b"), (None, 20, None, "b")]), ["destination_region"]))
    assert (r.trip_count, r.weighted_route_length, r.weighted_price, r.weighted_rub_per_km) == (60, 250, 4750, 17.5)


def test_error_metrics(spark):
    p = spark.createDataFrame([("v", 100.0, 1.0, 110.0), ("v", 200.0, 3.0, 180.0)], "variant string, actual_price double, qty double, predicted double")
    r = one(evaluation.metrics(p, ["variant"]))
    assert r.wape_pct == pytest.approx(10)
    assert r.weighted_mae == pytest.approx(17.5)
    assert r.mdape_pct == pytest.approx(10)
    assert r.bias_pct == pytest.approx(-100 * 50 / 700)
    assert (r.within_10_pct, r.within_20_pct) == (100, 100)


def text(spark, rule, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(rule(F.col("c"))).collect()]


def test_scalars(spark):
    assert text(spark, scalars.clean_text, [" a ", "NULL", "n/a", "", None, "\\N"]) == ["a", None, None, None, None, None]
    assert text(spark, scalars.parse_float, ["1,5", "2.5", "1d", "inf", "1_000", "x", "-3e2"]) == [1.5, 2.5, None, None, None, None, -300.0]
    assert text(spark, scalars.parse_int, ["3", "3.0", "2,5", " 7 "]) == [3, None, None, 7]
    assert text(spark, scalars.normalize_region, ["Г  Москва", "Санкт Петербург", "Орёл–область", " "]) == ["москва", "санкт-петербург", "орел-область", None]
    assert text(spark, scalars.strip_location_prefix, ["г. Тверь", "ДЕРЕВНЯ Ивановка", "Сочи", "г Ржев"]) == ["Тверь", "Ивановка", "Сочи", "Ржев"]
    assert text(spark, scalars.strip_legacy_prefix, ["гп Лесной", "Г Тверь", "пгт Юг"]) == ["Лесной", "Г Тверь", "Юг"]
    assert text(spark, scalars.parse_month, ["2026-05", "202605", "2026-05-17", "May"]) == ["2026-05", "2026-05", "2026-05", None]
    assert text(spark, scalars.period_label, ["202605", "x"]) == ["Май 2026", "x"]


def test_projection(spark):
    df = spark.createDataFrame([(55.75, 37.62), (56.86, 35.90)], "lat double, lon double")
    x, y = scalars.aeqd(F.col("lat"), F.col("lon"), F.lit(56.3), F.lit(36.8))
    back = scalars.aeqd_inverse(F.col("x"), F.col("y"), F.lit(56.3), F.lit(36.8))
    rows = df.select("lat", "lon", x.alias("x"), y.alias("y")).select("*", back[0].alias("la"), back[1].alias("lo")).collect()
    assert all(abs(r.la - r.lat) < 1e-8 and abs(r.lo - r.lon) < 1e-8 for r in rows)
    flat = math.dist((rows[0].x, rows[0].y), (rows[1].x, rows[1].y))
    true = one(spark.range(1).select(scalars.haversine_m(F.lit(55.75), F.lit(37.62), F.lit(56.86), F.lit(35.90)).alias("m"))).m
    assert abs(flat / true - 1) < 0.01


def points(spark, named, slice_="s"):
    return spark.createDataFrame([(slice_, k, float(x), float(y), 1, 1.0, 1.0) for k, (x, y) in named.items()], "slice string, id string, x double, y double, trip_count long, weighted_price double, weighted_rub_per_km double")


def test_two_far_groups(spark):
    p = points(spark, {"a": (0, 0), "b": (1, 0), "c": (0, 1), "d": (100, 0), "e": (101, 0), "f": (100, 1)})
    edges, _ = flows.spatial_graph(p)
    label = {r.id: r.component for r in graph.components(edges).collect()}
    assert label == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}


def test_far_point_is_isolated(spark):
    p = points(spark, {"a": (0, 0), "b": (1, 0), "c": (0, 1), "far": (100, 100)})
    edges, _ = flows.spatial_graph(p)
    assert [r.id for r in graph.isolated(p, edges).collect()] == ["far"]


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(260)]
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {v: root(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ward_equals_greedy(spark):
    r = random.Random(5)
    named = {f"p{i:02d}": (r.random() * 10, r.random() * 10) for i in range(24)}
    p = points(spark, named)
    near = sorted((math.dist(named[a], named[b]), a, b) for a, b in itertools.combinations(sorted(named), 2))[:60]
    edges = spark.createDataFrame([("s", a, b, d) for d, a, b in near], "slice string, a string, b string, distance double")
    feats = p.select("slice", "id", F.array("x", "y").alias("f"))
    label = graph.components(edges)
    log = zones.ward_merges(feats, edges)
    k = spark.createDataFrame([("s", 6)], "slice string, k int")
    parts = {}
    for row in zones.cut_partitions(log, label, k).collect():
        parts.setdefault(row.cluster_id, set()).add(row.id)
    own = {x.id for x in label.collect()}
    clusters = {i: ([i], named[i]) for i in own}
    links = {frozenset((a, b)) for _, a, b in near}
    sizes = {x.component: x.clusters for x in zones.seats(label.groupBy("slice", "component").agg(F.count("*").alias("size")), k).collect()}
    comp = {x.id: x.component for x in label.collect()}
    while True:
        live = {c: sum(1 for i in clusters if comp[i] == c) for c in sizes}
        best = min(((len(clusters[a][0]) * len(clusters[b][0]) / (len(clusters[a][0]) + len(clusters[b][0])) * math.dist(clusters[a][1], clusters[b][1]) ** 2, a, b) for a, b in (sorted(e) for e in links) if live[comp[a]] > sizes[comp[a]]), default=None)
        if best is None:
            break
        _, a, b = best
        (ma, ca), (mb, cb) = clusters[a], clusters.pop(b)
        clusters[a] = (ma + mb, tuple((u * len(ma) + v * len(mb)) / (len(ma) + len(mb)) for u, v in zip(ca, cb, strict=True)))
        links = {e2 for e in links if len(e2 := frozenset(a if x == b else x for x in e)) == 2}
    assert sorted(map(sorted, parts.values())) == sorted(sorted(m) for m, _ in clusters.values())


def test_agreement(spark):
    a = spark.createDataFrame([(i, i // 4) for i in range(12)], "id long, cluster_id int")
    b = spark.createDataFrame([(i, 2 - i // 4) for i in range(12)], "id long, cluster_id int")
    r = one(zones.membership_agreement(a, b, []))
    assert r.ari == pytest.approx(1) and r.nmi == pytest.approx(1)


def test_snapshot_rules(spark):
    rows = [("2026-01", "2026-02", "a", "r", 10.0, 1000.0, 100.0, 100.0, 0.5), ("2026-01", "2026-02", "b", "r", 10.0, 1000.0, 150.0, 100.0, 1.5), ("2026-01", "2026-02", "c", "r", -1.0, None, None, 100.0, None)]
    df = spark.createDataFrame(rows, "snapshot_month string, shipment_month string, actual_origin_id string, destination_region string, qty_total double, fact_rub_total double, fact_rub_per_item double, market_rub_per_item double, auction_percent double")
    good, bad = evaluation.check_snapshots(df)
    assert [r.actual_origin_id for r in good.collect()] == ["a"]
    assert {r.actual_origin_id: r.errors for r in bad.collect()} == {"b": ["auction_percent_scale", "price_mismatch"], "c": ["negative_qty_total"]}
    with pytest.raises(ValueError):
        evaluation.check_snapshots(df, mode="fail")
    assert evaluation.check_snapshots(df.union(df))[0].count() == 0


def test_leakage_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "actual_price double, pulse_price double")
    with pytest.raises(ValueError):
        evaluation.leakage_guard(df, ["actual_price"])
    evaluation.leakage_guard(df, ["pulse_price"])


def test_partitions_of_many_components_and_of_two_points(spark):
    from freightspark.plans import flows

    rows = [("many", f"p{i:02}{e}", 1000.0 * i + 10 * (e == "b"), 7.0 * (i % 5)) for i in range(21) for e in "ab"]
    rows += [("two", "q0", 0.0, 0.0), ("two", "q1", 5.0, 0.0)]
    points = spark.createDataFrame(rows, "slice string, id string, x double, y double")
    edges = spark.createDataFrame([("many", f"p{i:02}a", f"p{i:02}b", 10.0) for i in range(21)] + [("two", "q0", "q1", 5.0)], "slice string, a string, b string, distance double")
    got = flows.partition_modes(points, edges, ("geography",)).collect()
    assert len(got) == 44 and min(r.cluster_id for r in got) == 0
    assert {(s, len({r.cluster_id for r in got if r.slice == s})) for s in ("many", "two")} == {("many", 21), ("two", 2)}


def test_selected_k_equals_plain_rules(spark):
    """Undominated, fewest tiny clusters, near the best measure, least K: on random tables with ties and nulls."""
    r, rows = random.Random(5), []
    for s in range(30):
        for k in range(2, 2 + r.randint(1, 8)):
            silhouette = None if r.random() < 0.1 else round(r.uniform(-0.2, 0.8), 2)
            rows.append((f"s{s}", k, silhouette, float(r.randint(1, 4)), round(r.choice([0.0, 0.1, 0.3]), 1), round(r.choice([0.2, 0.5, 0.9]), 1), r.randint(0, 2), 40, float(r.randint(0, 5))))
    names = ["slice", "k", "silhouette", "p95_radius_m", "tiny_share", "size_cv", "tiny_clusters", "points", "mad"]
    df = spark.createDataFrame(rows, "slice string, k int, silhouette double, p95_radius_m double, tiny_share double, size_cv double, tiny_clusters long, points long, mad double")
    scored = zones.selection_score(df)
    got = {name: {(x.slice, x.k) for x in zones.select_k(scored, name, tolerance).where("selected").collect()} for name, tolerance in (("silhouette", 0.02), ("selection_score", 0.03))}
    want = {name: set() for name in got}
    for s in {x[0] for x in rows}:
        own = [dict(zip(names, x, strict=True)) for x in rows if x[0] == s]
        for name in ("silhouette", "mad"):
            values = [x[name] for x in own if x[name] is not None]
            for x in own:
                x[f"n_{name}"] = ((x[name] or 0) - min(values)) / (max(values) - min(values)) if len(set(values)) > 1 else None
        for x in own:
            good, even = x["n_silhouette"], x["n_mad"]
            x["selection_score"] = 0.7 * (1.0 if good is None else good) + 0.3 * (1.0 if even is None else 1 - even) - 0.1 * x["k"] / x["points"] - 0.2 * x["tiny_share"]
            x["c"] = (-x["silhouette"] if x["silhouette"] is not None else float("inf"), x["p95_radius_m"], x["tiny_share"], x["size_cv"], x["k"])
        front = [x for x in own if not any(all(a <= b for a, b in zip(y["c"], x["c"], strict=True)) and y["c"] != x["c"] for y in own)]
        sane = [x for x in front if x["tiny_clusters"] == min(y["tiny_clusters"] for y in front)]
        for name, tolerance in (("silhouette", 0.02), ("selection_score", 0.03)):
            best = max((x[name] for x in sane if x[name] is not None), default=None)
            near = sane if best is None else [x for x in sane if x[name] is not None and x[name] >= best - tolerance]
            want[name].add((s, min(x["k"] for x in near)))
    assert got == want


def test_dashboard_of_both_sides(spark):
    from freightspark.plans import flows

    rows = [("A", "X", "B", "Y", "retro", "spot", 100.0, 10.0, 2, "high"), ("A", "X", "B", "Z", "current", "spot", 0.0, 20.0, 4, "low"), ("A", "X", "C", "Z", "current", "tender", 300.0, None, None, "low"), ("D", "W", "C", "Z", "forecast", "tender", -5.0, 0.0, 1, None)]
    obs = spark.createDataFrame(rows, "origin_name string, origin_region string, destination_name string, destination_region string, period_type string, price_type string, price double, route_length double, trip_count long, confidence string")
    got = {(r.side, r.town, r.region): r for r in flows.dashboard(obs).collect()}
    assert set(got) == {("origin", "A", "X"), ("origin", "D", "W"), ("destination", "B", "Y"), ("destination", "B", "Z"), ("destination", "C", "Z")}
    a, d = got["origin", "A", "X"], got["origin", "D", "W"]
    assert (a.n_rows, a.avg_price, a.min_price, a.max_price, a.avg_length, a.min_length, a.max_length, a.avg_bids, a.rate) == (3, 200, 100, 300, 15, 10, 20, 3, 10)
    assert (a.n_current, a.avg_price_current, a.avg_length_current, a.rate_current, a.n_tender, a.avg_price_tender) == (2, 300, 20, 0, 1, 300)
    assert (a.top_destination_regions, a.top_origin_regions, a.confidence, a.period_types) == ("Z:2,Y:1", "X:3", "low", "current,retro")
    assert (d.avg_price, d.rate, d.confidence) == (0, 0, "—")
    assert {r.town for r in flows.dashboard(obs, from_regions=["X"], to_regions=["Z"], period_types=["current"]).where("side = 'destination'").collect()} == {"B", "C"}


def test_audit_counts_errors_and_repeats(spark):
    from freightspark.operators import catalog

    rows = [("a", -1.0, 0.0, 1, ["invalid_units"]), ("a", -1.0, 0.0, 1, []), ("b", 2.0, -3.0, -1, ["invalid_units", "invalid_nanos"]), (None, None, None, None, [])]
    obs = spark.createDataFrame(rows, "origin_fias string, price double, route_length double, trip_count long, validation_errors array<string>")
    got = {(r.section, r.name): r.n for r in catalog.audit_counts(obs, ["origin_fias", "price", "route_length", "trip_count"]).collect()}
    assert got == {
        ("rows", "total"): 4, ("rows", "duplicates"): 1, ("rows", "duplicate_business_keys"): 1, ("invalid_values", "price_negative"): 2, ("invalid_values", "route_length_zero"): 2,
        ("invalid_values", "route_length_negative"): 1, ("invalid_values", "trip_count_lt_zero"): 1, ("parse_errors", "invalid_units"): 2, ("parse_errors", "invalid_nanos"): 1,
    }
    profile = {r.field: (r.nulls, r.n_distinct, r.null_pct) for r in catalog.field_profile(obs, ["origin_fias", "price"]).collect()}
    assert profile == {"origin_fias": (1, 2, 25.0), "price": (1, 2, 25.0)}


def test_measures_are_those_of_the_whole_economics(spark):
    """Several names, some equally frequent or missing, gaps and zeros; no text is gathered by row."""
    rows = [("r", d, n, t, p, x) for d, n, t, p, x in (
        ("a", "n2", 3, 10.0, 5.0), ("a", "n1", 2, None, 4.0), ("a", None, 4, 7.0, 0.0), ("a", None, 1, 1.0, 1.0), ("a", None, None, 2.0, 2.0),
        ("b", None, 0, 10.0, 2.0), ("c", "z", 5, 0.0, 9.0), ("c", "z", 1, 8.0, 2.0), ("c", "y", 1, 8.0, 2.0), (None, "q", 1, 1.0, 1.0))]
    obs = spark.createDataFrame(rows, "destination_region string, destination_fias string, destination_name string, trip_count long, price double, route_length double")
    for c in ("period_type", "price_type", "vehicle_type", "tonnage_id", "period_id"):
        obs = obs.withColumn(c, F.lit("x"))
    got = economics.destination_measures(obs, ["destination_region"])
    want = economics.destination_economics(obs, ["destination_region"]).select(*got.columns)
    assert dict(got.dtypes) == dict(want.dtypes)
    key = lambda r: r.destination_fias
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "mode(" not in plan
