"""Points and grids against region boundaries.

A boundary is (region, ring, seq, lon, lat) vertices, in degrees or in metres of a plane; inside is the even-odd rule over all rings of
a region, so parts need not be dissolved and holes count. A point on an edge is covered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.scalars import EARTH_M
from freightspark.functions.shared import cut
from freightspark.operators.graph import components

#: Edges of a region for each of its bands.
EDGES_A_BAND = 8


def ring_edges(boundary: DataFrame) -> DataFrame:
    """(region, x1, y1, x2, y2): each vertex with the next of its ring, the last with the first."""
    w = W.partitionBy("region", "ring").orderBy("seq")
    whole = W.partitionBy("region", "ring").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return boundary.select("region", F.col("lon").alias("x1"), F.col("lat").alias("y1"), following("lon").alias("x2"), following("lat").alias("y2")).where("x1 != x2 or y1 != y2")


def edge_bands(boundary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges by band, bands of each region): a region's height is cut into bands, and an edge is in those that it spans."""
    e = ring_edges(boundary)
    tall = F.greatest("y1", "y2")
    box = e.groupBy("region").agg(F.min(F.least("y1", "y2")).alias("south"), (F.max(tall) - F.min(F.least("y1", "y2"))).alias("height"), F.ceil(F.count("*") / EDGES_A_BAND).alias("bands"))
    box = box.withColumn("step", F.when(F.col("height") > 0, F.col("height") / F.col("bands")).otherwise(1.0)).select("region", "south", "step")
    band = lambda y: F.floor((y - F.col("south")) / F.col("step"))
    return e.join(box, "region").select("region", "x1", "y1", "x2", "y2", F.explode(F.sequence(band(F.least("y1", "y2")), band(tall))).alias("band")), box


def edges_met(points: DataFrame, boundary: DataFrame) -> DataFrame:
    """(region, id, lon, lat) with each edge of the region in the point's band; points outside all bands are not there."""
    edges, box = edge_bands(boundary)
    at = points.select("region", "id", "lon", "lat").join(box, "region")
    return at.withColumn("band", F.floor((F.col("lat") - F.col("south")) / F.col("step"))).join(edges, ["region", "band"])


def covered(points: DataFrame, boundary: DataFrame) -> DataFrame:
    """Adds inside to (region, id, lon, lat, ...): crossings of a ray to the east are odd, or an edge holds the point.

    Points meet the edges of their region that span their band of latitude only.
    """
    x, y = F.col("lon"), F.col("lat")
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    at = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    cross = (x - F.col("x1")) * (F.col("y2") - F.col("y1")) - (y - F.col("y1")) * (F.col("x2") - F.col("x1"))
    on = (F.abs(cross) < 1e-12) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    test = edges_met(points, boundary).groupBy("region", "id").agg((F.sum((spans & (x < at)).cast("int")) % 2 == 1).alias("odd"), F.max(on).alias("on"))
    return points.join(test, ["region", "id"], "left").withColumn("inside", F.coalesce(F.col("odd") | F.col("on"), F.lit(False))).drop("odd", "on")


def boundary_audit(points: DataFrame, boundary: DataFrame) -> DataFrame:
    """Points and trips inside, bounding box and spherical area of each region."""
    p = covered(points, boundary).groupBy("region").agg(F.count("*").alias("points"), F.sum(F.col("inside").cast("long")).alias("points_inside"), (100.0 * F.sum(F.when(F.col("inside"), F.col("trip_count")).otherwise(0)) / F.nullif(F.sum("trip_count"), F.lit(0))).alias("trips_inside_pct"))
    box = boundary.groupBy("region").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    part = F.radians(F.col("x2") - F.col("x1")) * (2 + F.sin(F.radians("y1")) + F.sin(F.radians("y2")))
    area = ring_edges(boundary).groupBy("region").agg((F.abs(F.sum(part)) * EARTH_M * EARTH_M / 2 / 1e6).alias("area_km2"))
    return box.join(area, "region").join(p, "region", "left")


def territory_grid(boundary: DataFrame, medoids: DataFrame, cell: float) -> DataFrame:
    """(region, gx, gy, cluster_id): square cells over each region's box whose centre is covered, each with its nearest medoid's cluster (ties: the least).

    Boundary, medoids (region, cluster_id, lon, lat) and cell size are in the units of one plane.
    """
    if cell <= 0:
        raise ValueError("the cell size must be positive")
    box = boundary.groupBy("region").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), (F.max("lon") - F.min("lon")).alias("dx"), (F.max("lat") - F.min("lat")).alias("dy"))
    axis = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(c) / cell)).cast("int") - 1))
    grid = box.select("*", axis("dx").alias("gx")).select("*", axis("dy").alias("gy"))
    middle = lambda low, at: (F.col(low) + (F.col(at) + 0.5) * cell)
    grid = grid.select("region", "gx", "gy", F.concat_ws(":", "gx", "gy").alias("id"), middle("w", "gx").alias("lon"), middle("s", "gy").alias("lat"))
    own = covered(grid, boundary).where("inside")
    m = medoids.select("region", "cluster_id", F.col("lon").alias("mx"), F.col("lat").alias("my"))
    d = F.pow(F.col("lon") - F.col("mx"), 2) + F.pow(F.col("lat") - F.col("my"), 2)
    return own.join(m, "region").groupBy("region", "gx", "gy").agg(F.min(F.struct(d.alias("d"), "cluster_id")).alias("b")).select("region", "gx", "gy", F.col("b.cluster_id").alias("cluster_id"))


def zone_parts(cells: DataFrame) -> DataFrame:
    """(region, cluster_id, cells, parts): connected parts of each zone, cells being joined to those beside, above and below."""
    c = cut(cells.select("region", "cluster_id", "gx", "gy"), "cells")
    name = lambda x, y: F.concat_ws(":", F.col("cluster_id"), x, y)
    there = c.select("region", "cluster_id", "gx", "gy", name(F.col("gx"), F.col("gy")).alias("b"))
    beside = F.explode(F.array(F.struct((F.col("gx") + 1).alias("nx"), F.col("gy").alias("ny")), F.struct(F.col("gx").alias("nx"), (F.col("gy") + 1).alias("ny"))))
    here = c.select("region", "cluster_id", name(F.col("gx"), F.col("gy")).alias("a"), beside.alias("n")).select("region", "cluster_id", "a", F.col("n.nx").alias("gx"), F.col("n.ny").alias("gy"))
    edges = here.join(there, ["region", "cluster_id", "gx", "gy"]).select(F.col("region").alias("slice"), "a", "b")
    part = components(edges).select(F.col("slice").alias("region"), F.col("id").alias("b"), "component")
    return there.join(part, ["region", "b"], "left").groupBy("region", "cluster_id").agg(F.count("*").alias("cells"), F.countDistinct(F.coalesce("component", "b")).alias("parts"))


def territory_metrics(boundary: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """Per region: area of the cells as a share of the boundary's, share of cells with several zones, zones, most parts of a zone, zones in parts. Shares of a boundary without area are 0."""
    # rings within others are holes and run the other way round, or lie beside each other
    area = ring_edges(boundary).groupBy("region").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"))
    places = cells.groupBy("region", "gx", "gy").agg(F.count("*").alias("n")).groupBy("region").agg(F.count("*").alias("cells"), F.count_if(F.col("n") > 1).alias("shared"))
    zones = zone_parts(cells).groupBy("region").agg(F.count("*").alias("zone_count"), F.max("parts").alias("max_connected_components"), F.count_if(F.col("parts") > 1).alias("fragmented_zone_count"))
    share = lambda c: F.coalesce(100.0 * F.coalesce(F.col(c), F.lit(0)) * cell * cell / F.nullif(F.col("area"), F.lit(0.0)), F.lit(0.0))
    out = area.join(places, "region", "left").join(zones, "region", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("region", share("cells").alias("coverage_pct"), share("shared").alias("overlap_pct"), none("zone_count"), none("max_connected_components"), none("fragmented_zone_count"))
