"""Exports of saved slices: whole, refused or repeated."""

import json

import pytest

from freightspark.plans import flows

OBS = "destination_region string, destination_fias string, origin_region string, origin_fias string, price double, route_length double, trip_count long"
POINTS = "slice string, id string, x double, y double, trip_count long, weighted_route_length double, weighted_price double, weighted_rub_per_km double, length_trips long, price_trips long, rate_trips long"


@pytest.fixture(scope="module")
def saved(spark):
    obs = [("R", f"d{k % 6}", f"o{k % 2}", "s", 10.0 * k, 5.0, k % 4) for k in range(60)] + [("R", "d0", "o0", "s", None, None, None), ("Q", "d0", "o0", "s", 1.0, 1.0, 7)]
    obs = spark.createDataFrame(obs, OBS)
    trips = {}
    for r in obs.collect():
        trips[r[0], r[1]] = trips.get((r[0], r[1]), 0) + max(r.trip_count or 0, 0)
    points = spark.createDataFrame([(s, i, 0.0, 0.0, t, 5.0, 9.0, 2.0, t, t, t) for (s, i), t in trips.items()], POINTS)
    own = spark.createDataFrame([("R", f"d{k}", k % 2 if k < 4 else -1) for k in range(6)] + [("Q", "d0", 5)], "slice string, id string, cluster_id int")
    return obs, own, points


def test_rows_clusters_and_facts(spark, tmp_path, saved):
    obs, own, points = saved
    path = str(tmp_path / "deep" / "export")
    got = flows.export_saved(obs, own, points, path, {"mode": "bear_cost"}, sort="trips", descending=True, rows_a_file=7)
    rows = spark.read.parquet(f"{path}/rows")
    assert got["rows"] == rows.count() == 42 and got["points"] == 5
    assert {(r.destination_region, r.destination_fias) for r in rows.collect()} == {("R", "d0"), ("R", "d1"), ("R", "d2"), ("R", "d3"), ("Q", "d0")}
    # one folder an origin region and cluster, no file of more rows than allowed
    files = list((tmp_path / "deep/export/rows").glob("*/*/*.parquet"))
    assert {f.parent.name for f in files} == {"cluster_id=0", "cluster_id=1", "cluster_id=5"}
    assert all(spark.read.parquet(str(f)).count() <= 7 for f in files)
    clusters = spark.read.parquet(f"{path}/clusters").collect()
    assert sum(c.trips for c in clusters) == got["trips"] and {(c.slice, c.cluster_id) for c in clusters} == {("R", 0), ("R", 1), ("Q", 5)}
    facts = {r.fact: r.value for r in spark.read.json(f"{path}/facts").collect()}
    assert facts == {"mode": "bear_cost", "rows": "42", "points": "5", "trips": str(got["trips"])}


def test_nothing_is_left_of_a_refused_export(spark, tmp_path, saved):
    obs, own, points = saved
    for bad in (points.withColumn("trip_count", points.trip_count + 1), points.union(spark.createDataFrame([("R", "d9", 0.0, 0.0, 1, 1.0, 1.0, 1.0, 1, 1, 1)], POINTS))):
        more = own.union(spark.createDataFrame([("R", "d9", 1)], own.schema))
        with pytest.raises(ValueError, match="assigned are"):
            flows.export_saved(obs, more, bad, str(tmp_path / "x"))
        assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError, match="sort"):
        flows.export_saved(obs, own, points, str(tmp_path / "x"), sort="name")
    assert list(tmp_path.iterdir()) == []


def test_a_second_export_does_not_touch_the_first(spark, tmp_path, saved):
    obs, own, points = saved
    path = str(tmp_path / "once")
    flows.export_saved(obs, own, points, path)
    before = sorted(f.name for f in tmp_path.rglob("*.parquet"))
    with pytest.raises(FileExistsError):
        flows.export_saved(obs, own.where("cluster_id = 0"), points, path)
    assert sorted(f.name for f in tmp_path.rglob("*.parquet")) == before and [p.name for p in tmp_path.iterdir()] == ["once"]
    assert json.loads((next((tmp_path / "once/facts").glob("*.json"))).read_text().splitlines()[0])
