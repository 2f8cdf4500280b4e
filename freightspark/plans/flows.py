"""Composed flows: points with coordinates, graphs, zoning runs, comparison, evaluation and dashboards.

Every flow carries a slice column, so that all regions (or origin sets) run in one job instead of one at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.scalars import aeqd, strip_location_prefix
from freightspark.functions.shared import cut
from freightspark.operators import economics, evaluation, graph, zones
from freightspark.sources.sinks import staged


def resolve_coordinates(routes: DataFrame, coords: DataFrame) -> DataFrame:
    """Coordinates by exact name and region, else by the name without its settlement prefix; never guessed.

    source: cache_exact, cache_normalized, cache_null (the name is known without coordinates), not_in_cache.
    """
    known = coords.select(F.col("name").alias("_n"), F.col("region").alias("_r"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(True).alias("_has"))
    side = lambda s: known.select(*[F.col(c).alias(c + s) for c in known.columns])
    e, n = side("e"), side("n")
    out = routes.withColumn("_short", strip_location_prefix(F.col("destination_name")))
    out = out.join(e, (out.destination_name == e._ne) & (out.destination_region == e._re), "left")
    out = out.join(n, (out._short == n._nn) & (out.destination_region == n._rn), "left")
    good = lambda s: F.col(f"_lat{s}").between(-90, 90) & F.col(f"_lon{s}").between(-180, 180)
    first, second = F.coalesce(good("e"), F.lit(False)), F.coalesce(good("n"), F.lit(False))
    source = F.when(first, "cache_exact").when(second, "cache_normalized").when(F.col("_hase") | F.col("_hasn"), "cache_null").otherwise("not_in_cache")
    pick = lambda c: F.when(first, F.col(f"_{c}e")).when(second, F.col(f"_{c}n"))
    out = out.withColumns({"lat": pick("lat"), "lon": pick("lon"), "coordinate_source": source, "resolved": first | second})
    return out.select(*routes.columns, "lat", "lon", "coordinate_source", "resolved")


def project(points: DataFrame, keys: list[str]) -> DataFrame:
    """Metres about the mean latitude and longitude of each slice."""
    centre = points.groupBy(*keys).agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    x, y = aeqd(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return points.join(centre, keys).withColumns({"x": x, "y": y}).drop("lat0", "lon0")


def region_points(obs: DataFrame, coords: DataFrame) -> DataFrame:
    """Destinations of every region, all origins pooled, with coordinates: the input of graphs and zones."""
    routes = economics.destination_economics(obs, ["destination_region"])
    return resolve_coordinates(routes, coords)


def measured_points(obs: DataFrame, coords: DataFrame) -> DataFrame:
    """As region_points, with the measures and coordinates only: what graphs and zones need."""
    return resolve_coordinates(economics.destination_measures(obs, ["destination_region"]), coords)


def graph_points(points: DataFrame) -> DataFrame:
    """Resolved points as (slice, id, x, y, measures). Graphs are built before any business filter."""
    p = project(points.where("resolved"), ["destination_region"])
    return p.select(F.col("destination_region").alias("slice"), F.col("destination_fias").alias("id"), "x", "y", "trip_count", "weighted_route_length", "weighted_price", "weighted_rub_per_km", "length_trips", "price_trips", "rate_trips")


def spatial_graph(points: DataFrame, multiplier: float = graph.MULTIPLIER) -> tuple[DataFrame, DataFrame]:
    """(edges, thresholds): Delaunay edges up to the slice's adaptive threshold."""
    near = cut(graph.nearest_distance(points), "nearest")
    threshold = cut(graph.adaptive_threshold(near, multiplier), "thresholds")
    pairs = cut(graph.pairs_within(points.join(threshold, "slice"), "threshold"), "near-pairs")
    return cut(graph.delaunay_edges(points, pairs), "edges"), threshold


MODES = ("geography", "geo_cost", "geo_volume", "bear_cost", "bear_volume")


PARTITIONS = ("geography", "geo_cost", "geo_volume")
#: What should be even within the clusters of a mode, and its weight, as SQL.
VALUES = {"geography": ("null", "1"), "geo_cost": ("weighted_rub_per_km", "trip_count"), "geo_volume": ("log1p(greatest(trip_count, 0))", "1")}


def partition_modes(points: DataFrame, edges: DataFrame, modes: tuple[str, ...] = PARTITIONS, k: int | None = None) -> DataFrame:
    """(mode, slice, id, cluster_id) of the partitioning modes; -1 stands for no cluster.

    All modes and slices merge in the same rounds: the mode is part of the slice's name while they do. Without k
    each slice gets its own, chosen from a sweep over one merge log.
    """
    feats = inner = own = None
    linked = cut(graph.induced(edges, points).select("slice", "a", "b", "distance"), "linked")
    for mode in modes:
        name = F.concat_ws("@", F.lit(mode), "slice").alias("slice")
        p = zones.eligible(points, mode)
        value, weight = VALUES[mode]
        measured = p.select(name, "id", "x", "y", F.expr(value).cast("double").alias("value"), F.expr(weight).cast("double").alias("weight"))
        parts = (zones.features(p, mode).select(name, "id", "f"), (linked if zones.takes_all(mode) else graph.induced(linked, p)).select(name, "a", "b", "distance"), measured)
        feats, inner, own = parts if feats is None else tuple(x.unionByName(y) for x, y in zip((feats, inner, own), parts, strict=True))
    feats, inner, own = cut(feats, "features"), cut(inner, "induced"), cut(own, "eligible")
    label = cut(graph.components(inner), "labels")
    log = cut(zones.ward_merges(feats, inner, label), "ward-log")
    every = cut(zones.k_range(label), "k-range")
    if k is None:
        parts = cut(zones.cut_partitions(log, label, every), "sweep")
        geography = F.col("slice").startswith("geography@")
        # a slice with one K leaves nothing to choose, so its pairs of points need not meet
        choice = every.groupBy("slice").agg(F.count("*").alias("ks"))
        several = choice.where("ks > 1").select("slice")
        quality = cut(zones.partition_quality(own.join(several, "slice", "left_semi"), parts.join(several, "slice", "left_semi")), "quality")
        scored = cut(zones.selection_score(quality), "scores")
        picked = zones.select_k(scored.where(geography), tolerance=0.02).unionByName(zones.select_k(scored.where(~geography), "selection_score", 0.03))
        only = every.join(choice.where("ks = 1"), "slice", "left_semi").select("slice", "k")
        parts = parts.join(picked.where("selected").select("slice", "k").unionByName(only), ["slice", "k"], "left_semi")
    else:
        parts = zones.cut_partitions(log, label, every.where(F.col("k") == k))
    out = own.select("slice", "id").join(parts.select("slice", "id", "cluster_id"), ["slice", "id"], "left")
    name = F.split("slice", "@", 2)
    return out.select(name[0].alias("mode"), name[1].alias("slice"), "id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def assign(points: DataFrame, edges: DataFrame, mode: str, k: int | None = None) -> DataFrame:
    """(slice, id, cluster_id, cluster_type) for one mode over all slices; -1 stands for no cluster."""
    if mode in ("bear_cost", "bear_volume"):
        value, weight = ("weighted_rub_per_km", "trip_count") if mode == "bear_cost" else ("trip_count", None)
        return zones.high_zones(zones.eligible(points, mode), edges, value, weight).select("slice", "id", "cluster_id", "cluster_type")
    return partition_modes(points, edges, (mode,), k).select("slice", "id", "cluster_id", F.lit(None).cast("string").alias("cluster_type"))


def preview(obs: DataFrame, coords: DataFrame) -> DataFrame:
    """Data quality of each region before any graph."""
    return economics.data_quality(region_points(obs, coords), ["destination_region"])


def run(obs: DataFrame, coords: DataFrame, mode: str = "bear_cost", k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, cluster table, points) of one mode for all regions."""
    points = cut(graph_points(measured_points(obs, coords)), "points")
    edges, _ = spatial_graph(points)
    own = cut(assign(points, edges, mode, k), "assigned")
    table = economics.cluster_table(points.join(own, ["slice", "id"]), ["slice"])
    return own, table, points


def point_states(obs: DataFrame, coords: DataFrame, mode: str = "bear_cost") -> DataFrame:
    """(slice, id, cluster_id, status, warnings) of every destination, also those without coordinates or measures.

    warnings are those of the slice.
    """
    places = cut(region_points(obs, coords), "region-points")
    points = cut(graph_points(places), "points")
    edges, _ = spatial_graph(points)
    fit = zones.eligible(points, mode)
    if mode in ("bear_cost", "bear_volume"):
        value, weight = ("weighted_rub_per_km", "trip_count") if mode == "bear_cost" else ("trip_count", None)
        own = zones.high_zones(fit, edges, value, weight).select("slice", "id", "cluster_id", "cluster_type", "candidate")
    else:
        own = assign(points, edges, mode).select("*", F.lit(False).alias("candidate"))
    lone = graph.isolated(points, edges).withColumn("lone", F.lit(True))
    known = fit.select("slice", "id").withColumn("fit", F.lit(True))
    out = places.select(F.col("destination_region").alias("slice"), F.col("destination_fias").alias("id"), "resolved").where("id is not null")
    for part in (own, lone, known):
        out = out.join(part, ["slice", "id"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = zones.point_status(F.coalesce("cluster_id", F.lit(-1)), F.col("cluster_type"), no("candidate"), no("lone"), ~no("fit"))
    quality = economics.data_quality(places, ["destination_region"])
    economic = mode in ("geo_cost", "bear_cost")
    said = quality.select(
        F.col("destination_region").alias("slice"),
        zones.warnings(F.col("has_forecast") > 0, (F.col("mixed_periods") > 0) & F.lit(economic), F.col("resolved_points") < F.col("points"), (F.col("economic_valid") < F.col("points")) & F.lit(economic)).alias("warnings"),
    )
    return out.join(said, "slice", "left").select("slice", "id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), status.alias("status"), F.array_join("warnings", ",").alias("warnings"))


#: The multipliers that are compared.
MULTIPLIERS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0)


def pruning_sensitivity(points: DataFrame, multipliers: tuple[float, ...] = MULTIPLIERS) -> DataFrame:
    """Graph audit of each slice at each threshold multiplier, and the change in its number of components from one to the next.

    Edges do not depend on the threshold but for their length, so they are found once, for the greatest.
    """
    near = cut(graph.nearest_distance(points), "nearest")
    limit = None
    for m in multipliers:
        own = graph.adaptive_threshold(near, m).withColumn("multiplier", F.lit(float(m)))
        limit = own if limit is None else limit.unionByName(own)
    limit = cut(limit, "thresholds")
    widest = limit.groupBy("slice").agg(F.max("threshold").alias("threshold"))
    edges = cut(graph.delaunay_edges(points, cut(graph.pairs_within(points.join(widest, "slice"), "threshold"), "near-pairs")), "edges")
    key = lambda df: df.withColumn("slice", F.concat_ws("@", "slice", F.col("multiplier").cast("string")))
    kept = cut(key(edges.join(limit, "slice").where("distance <= threshold")).select("slice", "a", "b", "distance"), "kept-edges")
    audit = graph.graph_audit(key(points.select("slice", "id").join(limit, "slice")), kept, graph.components(kept))
    name = F.split("slice", "@")
    audit = audit.withColumns({"multiplier": F.element_at(name, -1).cast("double"), "slice": F.array_join(F.slice(name, 1, F.size(name) - 1), "@")})
    step = F.col("components") - F.lag("components").over(W.partitionBy("slice").orderBy("multiplier"))
    return audit.join(limit, ["slice", "multiplier"]).select("slice", "multiplier", "threshold", "components", step.alias("components_delta"), "isolated", "edges", "mean_edge", "p95_edge", "max_edge")


def method_comparison(points: DataFrame) -> DataFrame:
    """Graph audits of Delaunay and mutual nearest-neighbour edges, a row each and slice."""
    near = cut(graph.nearest_distance(points), "nearest")
    pairs = cut(graph.pairs_within(points.join(graph.adaptive_threshold(near), "slice"), "threshold"), "near-pairs")
    out = None
    for method, edges in (("delaunay", graph.delaunay_edges(points, pairs)), ("mutual_knn", graph.mutual_knn_edges(pairs))):
        edges = cut(edges, method)
        own = graph.graph_audit(points, edges, graph.components(edges)).withColumn("method", F.lit(method))
        out = own if out is None else out.unionByName(own)
    return out


def compare(obs: DataFrame, coords: DataFrame, k: int | None = None) -> DataFrame:
    """All five modes on one graph: clusters, assigned points and trips of each region and mode. No winner is named."""
    points = cut(graph_points(measured_points(obs, coords)), "points")
    edges, _ = spatial_graph(points)
    own = partition_modes(points, edges, PARTITIONS, k)
    for mode in ("bear_cost", "bear_volume"):
        own = own.unionByName(assign(points, edges, mode).select(F.lit(mode).alias("mode"), "slice", "id", "cluster_id"))
    own = points.join(own, ["slice", "id"]).where("cluster_id >= 0")
    return own.groupBy("mode", "slice").agg(F.countDistinct("cluster_id").alias("clusters"), F.count("*").alias("points"), F.sum("trip_count").alias("trips"))


def evaluation_rows(obs: DataFrame, snapshots: DataFrame, mapping: DataFrame, distances: DataFrame, month: str | None = None, assignments: DataFrame | None = None) -> DataFrame:
    """Ground truth joined with price cells, distances, clusters and the market's history, written once for all that reads it.

    Only the price cells of origins that the mapping names can meet a key, so others are left out before they are added up.
    """
    seen = cut(evaluation.as_of(snapshots, month), "snapshots")
    mapping = cut(mapping, "mapping")
    named = mapping.where("match_status = 'matched'").select("origin_fias").distinct()
    cells = evaluation.price_cells(obs.join(named, "origin_fias", "left_semi"))
    rows = evaluation.evaluation_dataset(evaluation.ground_truth(seen), mapping, cells, distances, assignments)
    return cut(rows.join(evaluation.market_history(seen), evaluation.KEY, "left"), "evaluation")


def dashboard(obs: DataFrame, from_regions: list[str] | None = None, to_regions: list[str] | None = None, period_types: list[str] | None = None, price_types: list[str] | None = None) -> DataFrame:
    """Both directions of the dashboard: a row for each town that sends or receives, with its `side`.

    Routes are those from and to the given regions; no list means all.
    """
    rows = obs
    for side, regions in (("origin", from_regions), ("destination", to_regions)):
        rows = rows.where(F.col(f"{side}_region").isin(*regions)) if regions else rows
    sides = [economics.direction_dashboard(rows, side, period_types, price_types).withColumn("side", F.lit(side)) for side in ("origin", "destination")]
    return sides[0].unionByName(sides[1])


def saved_rows(obs: DataFrame, own: DataFrame) -> DataFrame:
    """Source rows of all assigned points, with their cluster."""
    label = own.where("cluster_id >= 0").select(F.col("slice").alias("destination_region"), F.col("id").alias("destination_fias"), "cluster_id")
    return obs.join(label, ["destination_region", "destination_fias"])


TOTALS = ("rows", "points", "trips")


def _totals(rows: DataFrame) -> dict[str, int]:
    trips = F.sum(F.greatest(F.coalesce("trip_count", F.lit(0)), F.lit(0)))
    points = F.countDistinct("destination_region", "destination_fias")
    return dict(zip(TOTALS, map(int, rows.agg(F.count("*"), points, F.coalesce(trips, F.lit(0))).first()), strict=True))


def export_saved(obs: DataFrame, own: DataFrame, points: DataFrame, path: str, context: dict[str, str] | None = None, sort: str = "cluster_id", descending: bool = False, rows_a_file: int = 1_000_000) -> dict[str, int]:
    """Three tables below the path: `rows`, source rows of all assigned points by origin region and cluster, `clusters`, the cluster
    table in the given order, and `facts`, the context and the totals.

    All is written beside the path first. Rows, points and trips as written must equal those of the assigned points, trips also
    those of the cluster table; if not, nothing is left. A file has at most rows_a_file rows.
    """
    spark = obs.sparkSession
    label = own.where("cluster_id >= 0")
    table = economics.cluster_table(points.join(own, ["slice", "id"]), ["slice"])
    ordered = economics.sort_table(table, sort, descending)
    want = points.join(label, ["slice", "id"]).agg(F.count("*").alias("points"), F.coalesce(F.sum("trip_count"), F.lit(0)).alias("trips")).first()
    with staged(spark, path) as work:
        writer = saved_rows(obs, own).write.option("maxRecordsPerFile", rows_a_file)
        writer.partitionBy("origin_region", "cluster_id").parquet(f"{work}/rows")
        ordered.write.parquet(f"{work}/clusters")
        got = _totals(spark.read.parquet(f"{work}/rows"))
        listed = spark.read.parquet(f"{work}/clusters").agg(F.coalesce(F.sum("trips"), F.lit(0))).first()[0]
        if (got["points"], got["trips"], int(listed)) != (want.points, int(want.trips), int(want.trips)):
            raise ValueError(f"the export has {got['points']} points and {got['trips']} trips, its clusters {listed}; assigned are {want.points} and {want.trips}")
        facts = {**(context or {}), **{k: str(v) for k, v in got.items()}}
        spark.createDataFrame(sorted(facts.items()), "fact string, value string").coalesce(1).write.json(f"{work}/facts")
    return got
