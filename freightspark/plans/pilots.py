"""Many overlapping slices in one job: profiles of origins, region and filters over one table of mergeable partial sums.

The sums are per origin, destination and filter values, so that the observations are read once however many profiles hold
a row; a profile's economics are the merged sums of the states that belong to it. Graphs and modes then run over all profiles at
once, the profile being the slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightspark.functions.scalars import rub_per_km
from freightspark.functions.shared import cut
from freightspark.operators import graph, zones
from freightspark.plans import flows

FILTERS = ("period_type", "price_type", "vehicle_type", "tonnage_id")
#: Profiles that a freeze needs at least, and points of one that can be zoned.
LEAST_PROFILES, LEAST_POINTS = 5, 3
MODES = ("geography", "geo_cost")


@dataclass(frozen=True)
class Profile:
    """Origins (none given: all) and one region; an empty filter does not restrict."""

    name: str
    region: str
    origins: tuple[str, ...] = ()
    period_type: tuple[str, ...] = ("retro", "current", "forecast")
    price_type: tuple[str, ...] = ()
    vehicle_type: tuple[str, ...] = ()
    tonnage_id: tuple[str, ...] = ()


def partial_states(obs: DataFrame) -> DataFrame:
    """Sums of the measures and their own denominators by origin, destination, its name and filter values."""
    t, p, length = F.col("trip_count"), F.col("price"), F.col("route_length")
    rate = rub_per_km(p, length)

    def pair(value, ok, name: str) -> list:
        use = ok & value.isNotNull() & (t > 0)
        return [F.sum(F.when(use, value * t)).alias(f"{name}_sum"), F.coalesce(F.sum(F.when(use, t)), F.lit(0)).alias(f"{name}_trips")]

    keys = ["origin_fias", "destination_region", "destination_fias", "destination_name", *FILTERS]
    return obs.where("destination_fias is not null").groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum(F.when(t > 0, t)), F.lit(0)).alias("trip_count"),
        *pair(length, length > 0, "length"), *pair(p, p > 0, "price"), *pair(rate, F.lit(True), "rate"),
    )


def membership(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    """(slice, region, origin or null for all, filters): a row for each origin of a profile."""
    names = [p.name for p in profiles]
    if len(set(names)) < len(names):
        raise ValueError("profiles need names of their own")
    rows = [(p.name, p.region, o, *[list(getattr(p, f)) for f in FILTERS]) for p in profiles for o in (sorted(set(p.origins)) or [None])]
    return spark.createDataFrame(rows, "slice string, region string, origin string, " + ", ".join(f"only_{f} array<string>" for f in FILTERS))


def merged_economics(states: DataFrame, members: DataFrame) -> DataFrame:
    """(slice, destination...): the measures of each profile's destinations; a state counts in every profile that holds it."""
    known = (F.col("region") == F.col("destination_region")) & (F.col("origin").isNull() | (F.col("origin") == F.col("origin_fias")))
    for f in FILTERS:
        known = known & ((F.size(f"only_{f}") == 0) | F.coalesce(F.array_contains(f"only_{f}", F.col(f)), F.lit(False)))
    own = states.join(members, known)
    keys = ["slice", "destination_region", "destination_fias"]
    sums = ["n_rows", "trip_count", *[f"{m}_{e}" for m in ("length", "price", "rate") for e in ("sum", "trips")]]
    by_name = cut(own.groupBy(*keys, "destination_name").agg(*[F.sum(c).alias(c) for c in sums]), "profile-sums")
    # the most frequent name (ties: the least)
    order = F.struct((-F.col("n_rows")).alias("n"), F.col("destination_name").alias("name"))
    merged = by_name.groupBy(*keys).agg(F.min(F.when(F.col("destination_name").isNotNull(), order))["name"].alias("destination_name"), *[F.sum(c).alias(c) for c in sums])
    mean = lambda m: F.col(f"{m}_sum") / F.nullif(F.col(f"{m}_trips"), F.lit(0))
    return merged.select(*keys, "destination_name", "n_rows", "trip_count", mean("length").alias("weighted_route_length"), mean("price").alias("weighted_price"), mean("rate").alias("weighted_rub_per_km"), "length_trips", "price_trips", "rate_trips")


def pilots(obs: DataFrame, coords: DataFrame, profiles: list[Profile]) -> DataFrame:
    """A row for each profile and mode: status, rows, points, clusters, assigned points and trips, and clusters that do not hang together.

    A profile with fewer than LEAST_POINTS resolved points has one row with that status. No winner is named.
    """
    if len(profiles) < LEAST_PROFILES:
        raise ValueError(f"needs at least {LEAST_PROFILES} profiles")
    members = membership(obs.sparkSession, profiles)
    routes = cut(merged_economics(partial_states(obs), members), "profile-economics")
    places = flows.resolve_coordinates(routes, coords)
    points = flows.project(places.where("resolved"), ["slice"]).withColumnRenamed("destination_fias", "id")
    points = cut(points.select("slice", "id", "x", "y", "trip_count", "weighted_route_length", "weighted_price", "weighted_rub_per_km", "length_trips", "price_trips", "rate_trips"), "profile-points")
    size = points.groupBy("slice").agg(F.count("*").alias("points"))
    enough = points.join(size.where(F.col("points") >= LEAST_POINTS).select("slice"), "slice", "left_semi")
    edges, _ = flows.spatial_graph(enough)
    found = flows.partition_modes(enough, edges, MODES)
    bear = flows.assign(enough, edges, "bear_cost").select(F.lit("bear_cost").alias("mode"), "slice", "id", "cluster_id")
    found = cut(found.unionByName(bear), "profile-zones")
    # a mode's zones on a graph of its own
    key = F.concat_ws("@", "mode", "slice").alias("slice")
    modes = found.select("mode").distinct()
    torn = graph.connectivity_violations(edges.crossJoin(F.broadcast(modes)).select(key, "a", "b", "distance"), found.select(key, "id", "cluster_id"))  # three modes
    torn = torn.groupBy(F.col("slice").alias("run")).agg(F.count("*").alias("violations"))
    facts = found.join(points.select("slice", "id", "trip_count"), ["slice", "id"]).groupBy("slice", "mode").agg(
        F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"), F.count_if(F.col("cluster_id") >= 0).alias("assigned"),
        F.coalesce(F.sum(F.when(F.col("cluster_id") >= 0, F.col("trip_count"))), F.lit(0)).alias("assigned_trips"),
    )
    facts = facts.join(torn, F.concat_ws("@", "mode", "slice") == F.col("run"), "left").drop("run").withColumn("violations", F.coalesce("violations", F.lit(0)))
    rows = routes.groupBy("slice").agg(F.sum("n_rows").alias("source_rows"))
    out = members.select("slice").distinct().join(rows, "slice", "left").join(size, "slice", "left").join(facts, "slice", "left")
    few = F.coalesce(F.col("points"), F.lit(0)) < LEAST_POINTS
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("slice").alias("profile"), "mode", F.when(few, "insufficient_resolved_points").otherwise("completed").alias("status"), none("source_rows"), none("points"), "clusters", "assigned", "assigned_trips", "violations")
