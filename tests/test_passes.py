"""How often the queries read and shuffle their large tables."""

import re

from freightspark.functions import order_statistics
from freightspark.functions.shared import cut
from freightspark.operators import economics, evaluation
from freightspark.plans import registry
from freightspark.sources import standins as src


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table: str) -> int:
    return len(re.findall(rf"Scan parquet [^\n]*/{table}\.parquet", plan(df)))


def test_lines_are_not_shuffled_by_customer(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(src.observations(spark, sf)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(o_custkey" in x or "Exchange hashpartitioning(c_custkey" in x]
    assert len(shuffles) == 2
    for i in shuffles:
        depth = lines[i].index("Exchange")
        below = []
        for x in lines[i + 1 :]:
            if len(re.match(r"[\s:+\-|*()\d]*", x).group()) <= depth:
                break
            below.append(x)
        assert below and not any("lineitem.parquet" in x for x in below)


def test_evaluation_rows_are_computed_once(spark, sf):
    assert scans(registry._predictions(spark, sf), "lineitem") == 0
    assert scans(registry._clustered(spark, sf), "lineitem") == 0


def test_economics_read_observations_once(spark, sf):
    assert scans(economics.destination_economics(src.observations(spark, sf), ["destination_region"]), "lineitem") == 1


def test_dashboard_reads_observations_once(spark, sf):
    assert scans(economics.direction_dashboard(src.observations(spark, sf), "origin"), "lineitem") == 1


def test_dashboard_counts_regions_and_confidence(spark):
    row = lambda o, d, c: ("a", o, "t", d, 10.0, 2.0, 1, "retro", "spot", c)
    rows = [row("x", "p", "low"), row("x", "p", None), row("x", "q", "high"), row("x", "q", "—"), row("x", None, "—")]
    cols = "origin_name string, origin_region string, destination_name string, destination_region string, price double, route_length double, trip_count long, period_type string, price_type string, confidence string"
    got = economics.direction_dashboard(spark.createDataFrame(rows, cols), "origin").first()
    assert (got.n_rows, got.rate, got.confidence) == (5, 5.0, "high")
    assert (got.top_origin_regions, got.top_destination_regions) == ("x:5", "p:2,q:2")


def test_distance_hypothesis_writes_lines_once(spark, sf, monkeypatch):
    """Lines are read and written once, and no table of their errors is made: values that hardly repeat are counted by cells."""
    sizes = {}

    def counted(df, name):
        out = cut(df, name)
        sizes.setdefault(name, []).append((scans(df, "lineitem"), out.count()))
        return out

    for module in (evaluation, order_statistics, registry):
        monkeypatch.setattr(module, "cut", counted)
    got = registry.queries()["a25_distance_hypothesis"](spark, sf)
    assert got.count() == 3 and scans(got, "lineitem") == 0
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert sorted(n for rows in sizes.values() for _, n in rows)[-1] == lines
    assert sum(n for rows in sizes.values() for n, _ in rows) == 1
    assert sum(n for rows in sizes.values() for _, n in rows) < 2 * lines


def test_distance_hypothesis_of_trips_beside_the_market(spark):
    """Cells are those of market rows only, whole ones; a cell without them has no rate."""
    rows = [("o", "r", "1", 10.0, 2.0, 1, True, False), ("o", "r", "1", 30.0, 2.0, None, True, False), ("o", "r", "2", 8.0, None, 1, True, False)]
    rows += [("o", "r", "1", 20.0, 1.0, 2, False, True), ("o", "r", "2", 10.0, 1.0, 1, False, True), ("o", "r", "3", 10.0, 3.0, 1, False, True), ("o", "r", "3", None, 3.0, 1, False, True)]
    df = spark.createDataFrame(rows, "origin_fias string, destination_region string, period_id string, price double, route_length double, trip_count long, market boolean, trip boolean")
    got = {r.variant: (round(r.coverage, 6), round(r.wape_pct, 6), round(r.mdape_pct, 6)) for r in evaluation.distance_hypothesis(df).collect()}
    # rate of the first cell 10, mean prices 20 and 8; a trip without a price counts only where its prediction is missing too
    assert got == {"cell_rate": (0.25, 50.0, 50.0), "mean_rate": (1.0, 66.666667, 50.0), "mean_price": (1.0, 33.333333, 40.0)}
