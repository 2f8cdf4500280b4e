"""File scans on small literal files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from freightspark.sources import scans


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_observations(spark, tmp_path):
    names = [c for c in scans.OBSERVATION_COLUMNS if c in scans.REQUIRED]
    good = dict.fromkeys(names, "x") | {"units": "1000,5", "route_length": "10", "bid_count": "3", "period_id": "202601"}
    bad = good | {"units": "1d", "bid_count": "3.0", "period_id": "2026"}
    path = write(tmp_path, "o.csv", "﻿" + "\n".join([",".join(names), *(",".join(f'"{r[c]}"' for c in names) for r in (good, bad))]))
    a, b = scans.scan_observations(spark, path).collect()
    assert (a.price, a.trip_count, a.validation_errors) == (1000.5, 3, [])
    assert (b.price, b.trip_count, b.validation_errors) == (None, None, ["invalid_units", "invalid_bid_count", "invalid_period_id"])
    assert len(scans.scan_raw(spark, path).columns) == 25
    with pytest.raises(ValueError, match="units"):
        scans.scan_raw(spark, write(tmp_path, "x.csv", "a,b\n1,2\n"))


def test_dimensions(spark, tmp_path):
    path = write(tmp_path, "d.csv", "origin_fias,destination_region,distance_km,source\no1,Г Москва,10,manual_verified\no1,x,0,guess\n")
    ok, bad = scans.scan_distances(spark, path)
    assert [r.destination_region for r in ok.collect()] == ["москва"]
    assert bad.collect()[0].errors == ["distance_not_positive", "source_not_approved"]
    path = write(tmp_path, "m.csv", "actual_origin_id,pulse_origin_fias\na,f\na,g\n")
    with pytest.raises(ValueError):
        scans.scan_origin_mapping(spark, path)


def test_coordinates_and_boundary(spark, tmp_path):
    path = write(tmp_path, "c.json", json.dumps({"A::R": [50.0, 30.0], "B::R": None, "C::R": [95.0, 30.0]}))
    assert {r.name: (r.lat, r.lon) for r in scans.scan_coordinates(spark, path).collect()} == {"A": (50.0, 30.0), "B": (None, None), "C": (None, None)}
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": square}} for n in ("One", "Two")]
    path = write(tmp_path, "b.json", json.dumps({"type": "FeatureCollection", "features": features}))
    assert scans.scan_boundary(spark, path, " one").count() == 5
    with pytest.raises(ValueError):
        scans.scan_boundary(spark, path)
    with pytest.raises(ValueError):
        scans.scan_boundary(spark, path, "three")


def test_snapshots_and_their_sinks(spark, tmp_path):
    from freightspark.operators import economics, evaluation
    from freightspark.sources import sinks

    names = scans.SNAPSHOT_COLUMNS
    good = dict.fromkeys(names, "") | {"current_month": "2026-01", "shipment_date_month": "202603", "month_label": "M2", "shipment_point_name": "A", "delivery_point_name": "B", "qty_total": "4", "fact_rub_total": "40", "fact_rub_per_item": "10", "auction_percent": "0.5"}
    bad = good | {"current_month": "2026-02", "auction_percent": "1.5", "month_label": "M9", "fact_rub_per_item": "20"}
    path = write(tmp_path, "s.csv", "\n".join([",".join(names), *(",".join(r[c] for c in names) for r in (good, bad))]))
    rows = scans.scan_actual_snapshots(spark, path)
    a, b = rows.orderBy("snapshot_month").collect()
    assert (a.horizon, a.label_ok, a.qty_total, a.market_rub_per_item) == (2, True, 4.0, None) and (b.horizon, b.label_ok) == (1, False)
    kept, rejected = evaluation.check_snapshots(rows)
    assert kept.count() == 1 and rejected.first().errors == ["auction_percent_scale", "price_mismatch", "month_label_mismatch"]
    short = write(tmp_path, "t.csv", "current_month,shipment_date_month,month_label,shipment_point_name,delivery_point_name\n")
    with pytest.raises(ValueError, match="qty_total"):
        scans.scan_actual_snapshots(spark, short)
    names = (tmp_path / "s.csv").read_text().split("\n")[0].split(",")
    assert names.index("market_rub_total") + 1 == names.index("fact_rub_per_item") == 12
    obs = spark.createDataFrame([("202601", "o1", "d1", 10.0, 2.0, 3), ("202602", "o1", None, 20.0, 4.0, 1)], "period_id string, origin_fias string, destination_fias string, price double, route_length double, trip_count long")
    sinks.write_baseline(economics.rate_baseline(obs), str(tmp_path / "base"))
    got = spark.read.option("header", True).csv(str(tmp_path / "base"))
    assert {(r.dimension, r.value, r.n_rows) for r in got.collect()} == {("overall", "all", "2"), ("period", "202601", "1"), ("period", "202602", "1"), ("origin", "o1", "2"), ("destination", "d1", "1"), ("destination", "<missing>", "1")}
    one = spark.range(1).select("id")
    own = {c: sinks.EVALUATION_NAMES.get(c, c) for c in sinks.EVALUATION_COLUMNS}
    filled = one.select(*[F.lit(c).alias(n) for c, n in own.items()])
    sinks.write_evaluation(filled, one, one, one, str(tmp_path / "eval"))
    back = spark.read.option("header", True).csv(str(tmp_path / "eval/rows"))
    assert back.columns == list(sinks.EVALUATION_COLUMNS) == list(back.first())


def test_rejects_are_counted_while_they_are_written(spark, tmp_path):
    from freightspark.sources import sinks

    rows = spark.createDataFrame([(1, []), (2, ["a"]), (3, ["a", "b"]), (4, [])], "id int, errors array<string>")
    with pytest.raises(ValueError, match="2 of 4 rows break a rule: a 2, b 1"):
        sinks.write_checked(rows, str(tmp_path / "out"), ("a", "b", "c"), strict=True)
    assert list(tmp_path.iterdir()) == []
    assert sinks.write_checked(rows, str(tmp_path / "out"), ("a", "b", "c")) == {"rows": 4, "rejected": 2, "a": 2, "b": 1, "c": 0}
    assert {r.id: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "accepted", 2: "rejected", 3: "rejected", 4: "accepted"}
    with pytest.raises(FileExistsError):
        sinks.write_checked(rows, str(tmp_path / "out"), ("a",))
    good = rows.where("size(errors) = 0")
    assert sinks.write_checked(good, str(tmp_path / "good"), ("a",), strict=True) == {"rows": 2, "rejected": 0, "a": 0}


def test_dataset_hash_and_snapshot(spark, tmp_path):
    base = spark.createDataFrame([("r", i, f"t{i % 7}") for i in range(200)] + [("q", 1, None)], "region string, n int, t string")
    hashes = lambda df: {r.region: (r.n_rows, r.dataset_hash) for r in scans.dataset_hash(df, ["region"], ["n", "t"]).collect()}
    want = hashes(base)
    assert hashes(base.orderBy("t").repartition(7)) == want and want["r"][0] == 200
    for other in (base.where("n != 5"), base.union(base.limit(1)), base.withColumn("t", F.when(F.col("n") == 9, "x").otherwise(F.col("t")))):
        assert hashes(other)["r"] != want["r"] and hashes(other)["q"] == want["q"]
    path = str(tmp_path / "data")
    base.write.parquet(path)
    token = scans.data_snapshot(spark.read.parquet(path))
    assert scans.demand_snapshot(spark.read.parquet(path), token).count() == 201
    base.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="changed"):
        scans.demand_snapshot(spark.read.parquet(path), token)


def test_manifest(spark, tmp_path):
    boundary = write(tmp_path, "b.json", "{}")
    good = {"region": "r", "authority": "a", "source_type": "file", "retrieved_at": "2026-01-01", "crs": "EPSG:4326", "sha256": hashlib.sha256(b"{}").hexdigest(), "official": True}
    assert scans.scan_manifest(spark, write(tmp_path, "m.json", json.dumps(good, indent=1)), boundary, require_official=True)["official"] is True
    for change, said in (({"sha256": "0" * 64}, "another"), ({"authority": None}, "authority"), ({"official": False}, "official")):
        with pytest.raises(ValueError, match=said):
            scans.scan_manifest(spark, write(tmp_path, "m2.json", json.dumps(good | change)), boundary, require_official=True)


def test_boundary_by_any_name_field(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    features = [{"type": "Feature", "properties": {f: f"Region {f}", "id": "Region x"}, "geometry": {"type": "Polygon", "coordinates": square}} for f in scans.NAME_FIELDS]
    path = write(tmp_path, "n.json", json.dumps({"type": "FeatureCollection", "features": features}))
    for f in scans.NAME_FIELDS:
        same = sum(x.lower() == f.lower() for x in scans.NAME_FIELDS)
        assert scans.scan_boundary(spark, path, f"region {f}").count() == 5 * same
    with pytest.raises(ValueError):
        scans.scan_boundary(spark, path, "region x")
