"""Boundaries, grids, K-means and sinks on literal shapes."""

import pytest

from freightspark.operators import territory
from freightspark.sources import sinks

SQUARE = [("r", "a", k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])]
HOLE = [("r", "b", k, float(x), float(y)) for k, (x, y) in enumerate([(1, 1), (2, 1), (2, 2), (1, 2)])]


@pytest.fixture(scope="module")
def boundary(spark):
    return spark.createDataFrame(SQUARE + HOLE, "region string, ring string, seq int, lon double, lat double")


def test_covered(spark, boundary):
    p = spark.createDataFrame([("r", i, x, y, 1) for i, x, y in (("in", 3.0, 3.0), ("hole", 1.5, 1.5), ("out", 5.0, 1.0), ("edge", 4.0, 2.0), ("corner", 0.0, 0.0))], "region string, id string, lon double, lat double, trip_count long")
    assert {r.id: r.inside for r in territory.covered(p, boundary).collect()} == {"in": True, "hole": False, "out": False, "edge": True, "corner": True}
    r = territory.boundary_audit(p, boundary).collect()[0]
    assert (r.points, r.points_inside, r.west, r.north) == (5, 3, 0.0, 4.0) and r.trips_inside_pct == pytest.approx(60)
    assert r.area_km2 == pytest.approx(16 * 111.2**2, rel=0.1)


def test_grid(spark, boundary):
    m = spark.createDataFrame([("r", 0, 0.0, 2.0), ("r", 1, 4.0, 2.0)], "region string, cluster_id int, lon double, lat double")
    cells = territory.territory_grid(boundary, m, 1.0)
    rows = cells.collect()
    assert len(rows) == 15 and all(r.cluster_id == (r.gx >= 2) for r in rows)
    r = territory.territory_metrics(boundary, cells, 1.0).collect()[0]
    assert (r.zone_count, r.max_connected_components, r.fragmented_zone_count, r.overlap_pct) == (2, 1, 0, 0)
    with pytest.raises(ValueError):
        territory.territory_grid(boundary, m, 0.0)


def test_territory_of_a_rectangle_is_whole(spark):
    """All of the boundary belongs to the zones, without overlap; noise has none."""
    ring = spark.createDataFrame([("r", "o", k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0)])], "region string, ring string, seq int, lon double, lat double")
    for medoids in ([("r", 0, 3.0, 5.0), ("r", 1, 17.0, 5.0)], [("r", 4, 3.0, 5.0)]):
        m = spark.createDataFrame(medoids, "region string, cluster_id int, lon double, lat double")
        r = territory.territory_metrics(ring, territory.territory_grid(ring, m, 2.0), 2.0).collect()[0]
        assert (r.coverage_pct, r.overlap_pct, r.zone_count) == (pytest.approx(100), 0, len(medoids))


def test_parts_of_zones(spark):
    cells = spark.createDataFrame([("r", x, y, c) for x, y, c in ((0, 0, 1), (1, 0, 1), (3, 0, 1), (2, 1, 1), (0, 1, 2), (1, 1, 2), (0, 2, 2), (9, 9, 3))], "region string, gx int, gy int, cluster_id int")
    assert {(r.cluster_id, r.cells, r.parts) for r in territory.zone_parts(cells).collect()} == {(1, 4, 3), (2, 3, 1), (3, 1, 1)}


def test_points_meet_few_edges(spark):
    """A ring of 4 000 edges: a point meets those of its band, and the answer is that of the circle."""
    import math

    n = 4000
    ring = spark.createDataFrame([("r", "o", k, math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)], "region string, ring string, seq int, lon double, lat double")
    rows = [("r", f"p{k}", 1.2 * math.cos(k) * (k % 97) / 97, 1.2 * math.sin(k) * (k % 97) / 97) for k in range(1, 500)] + [("r", "far", 5.0, 9.0), ("other", "x", 0.0, 0.0)]
    p = spark.createDataFrame(rows, "region string, id string, lon double, lat double")
    got = {(r.region, r.id): r.inside for r in territory.covered(p, ring).collect()}
    assert got == {(g, i): g == "r" and math.hypot(x, y) < 1 for g, i, x, y in rows}
    assert territory.edges_met(p, ring).count() < 60 * len(rows)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2])], "k string, v array<int>")
    sinks.write_with_report(df, df.selectExpr("count(*) as n"), str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "o/table")).collect()[0].v == "1,2"
    assert sinks.flat_report(df.selectExpr("1 as n", "2.5 as x"), "s").collect()[1].value == "2.5"
    with pytest.raises(Exception):
        sinks.write_table(df, str(tmp_path / "o/table"))
