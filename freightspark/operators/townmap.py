"""The town map: coordinates with region centres as the last resort, filters from both ends, and upkeep of stored coordinates.

Coordinates are (name, region, lat, lon); a row with null lat and lon says that the name is known without a place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.functions.scalars import strip_location_prefix
from freightspark.operators.economics import metric_aggregates

#: What the names of villages begin with.
RURAL = ("д ", "с ", "п ", "пос ", "х ", "ст ", "рп ", "с/с ", "пгт ")


def resolve_with_centre(towns: DataFrame, coords: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds lat, lon and source to (town, region): the exact name, else the name without its prefix, else the region's centre.

    A name that is stored without a place ends the search: it gets the centre, as unknown names do.
    """
    known = coords.select(F.col("name").alias("n"), F.col("region").alias("r"), "lat", "lon")
    side = lambda s: known.select(*[F.col(c).alias(c + s) for c in known.columns], F.lit(True).alias(f"has{s}"))
    out = towns.withColumn("short", strip_location_prefix(F.col("town")))
    e, n, c = side("e"), side("s"), centres.select(F.col("region").alias("rc"), F.col("lat").alias("latc"), F.col("lon").alias("lonc"))
    out = out.join(e, (out.town == e.ne) & (out.region == e.re), "left").join(n, (out.short == n.ns) & (out.region == n.rs), "left").join(c, out.region == c.rc, "left")
    exact, short = F.col("hase").isNotNull(), F.col("hass").isNotNull()
    found = F.when(exact, F.col("late").isNotNull()).when(short, F.col("lats").isNotNull()).otherwise(False)
    pick = lambda x: F.when(found & exact, F.col(f"{x}e")).when(found, F.col(f"{x}s")).otherwise(F.col(f"{x}c"))
    source = F.when(found & exact, "exact").when(found, "normalized").when(F.col("latc").isNotNull(), "centre").otherwise("missing")
    return out.select(*towns.columns, pick("lat").alias("lat"), pick("lon").alias("lon"), source.alias("source"))


def towns_of(obs: DataFrame) -> DataFrame:
    """(side, town, region) of both ends, each once."""
    ends = [obs.select(F.lit(s).alias("side"), F.col(f"{s}_name").alias("town"), F.col(f"{s}_region").alias("region")) for s in ("origin", "destination")]
    return ends[0].union(ends[1]).where("town is not null").distinct()


def map_points(obs: DataFrame, origins: list[str] | None = None, destinations: list[str] | None = None) -> DataFrame:
    """Towns of both ends with their measures. Regions of an end choose its towns, and the rows of the towns at the other end."""
    rows = obs
    for column, chosen in (("origin_region", origins), ("destination_region", destinations)):
        if chosen:
            rows = rows.where(F.col(column).isin(*chosen))
    ends = [rows.groupBy(F.col(f"{s}_name").alias("town"), F.col(f"{s}_region").alias("region")).agg(*metric_aggregates()).withColumn("side", F.lit(s)) for s in ("origin", "destination")]
    return ends[0].unionByName(ends[1]).where("town is not null")


def town_records(obs: DataFrame, side: str, town: str, region: str, **choices: list[str]) -> DataFrame:
    """The rows of one town at one end; choices are column = values, whatever their case, and an empty list chooses all."""
    if side not in ("origin", "destination"):
        raise ValueError("side must be origin or destination")
    unknown = set(choices) - {"origin_region", "destination_region", "period_type", "price_type"}
    if unknown:
        raise ValueError(f"no such selection: {sorted(unknown)}")
    out = obs.where((F.col(f"{side}_name") == town) & (F.col(f"{side}_region") == region))
    for column, values in choices.items():
        if values:
            out = out.where(F.upper(column).isin(*[v.upper() for v in values]))
    return out


def town_coverage(obs: DataFrame, coords: DataFrame, centres: DataFrame) -> DataFrame:
    """One row: distinct towns of both ends, of each end, those with and without coordinates."""
    towns = towns_of(obs)
    each = resolve_with_centre(towns.select("town", "region").distinct(), coords, centres)
    both = each.agg(F.count("*").alias("towns"), F.count("lat").alias("geocoded"), F.count_if(F.col("lat").isNull()).alias("missing"))
    side = towns.agg(F.count_if(F.col("side") == "origin").alias("origin_towns"), F.count_if(F.col("side") == "destination").alias("destination_towns"))
    return both.crossJoin(side)  # one row each


def without_centre_coordinates(coords: DataFrame, centres: DataFrame) -> DataFrame:
    """Stored coordinates without villages that were given a region's centre."""
    rural = F.lit(False)
    for prefix in RURAL:
        rural = rural | F.trim("name").startswith(prefix)
    at = centres.select("lat", "lon").distinct()
    wrong = coords.where(rural).join(at, ["lat", "lon"], "left_semi").select("name", "region").distinct()
    return coords.join(wrong, ["name", "region"], "left_anti")


def backfill_keys(towns: DataFrame, coords: DataFrame, old: DataFrame) -> DataFrame:
    """(town, region, lat, lon) of towns without an entry of their own that an older one by name alone (as it is, else without prefix) has coordinates for."""
    lacking = towns.join(coords.select(F.col("name").alias("town"), "region"), ["town", "region"], "left_anti").withColumn("short", strip_location_prefix(F.col("town")))
    one = old.groupBy("name").agg(F.min(F.struct("lat", "lon")).alias("p"))
    a = one.select(F.col("name").alias("town"), F.col("p").alias("a"))
    b = one.select(F.col("name").alias("short"), F.col("p").alias("b"))
    out = lacking.join(a, "town", "left").join(b, "short", "left").withColumn("p", F.coalesce("a", "b"))
    return out.where("p.lat is not null").select("town", "region", "p.lat", "p.lon")
