"""Spatial neighbour graphs of many slices at once: pairs, adaptive threshold, Delaunay and mutual-kNN edges, components.

Points are (slice, id, x, y, ...) in metres. Candidate pairs come from a grid whose cell is the slice's threshold,
so a point meets the points of nine cells and never its whole slice.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.components import connected_components
from freightspark.functions.shared import cut

MULTIPLIER = 3.0


def _around(points: DataFrame, cell: str) -> DataFrame:
    """Each point once for its own cell and the eight beside it: what a point of that cell may meet."""
    near = F.explode(F.array(*[F.struct((F.floor(F.col("x") / F.col(cell)) + i).alias("gx"), (F.floor(F.col("y") / F.col(cell)) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return points.select("*", near.alias("g")).select("*", "g.gx", "g.gy").drop("g")


def pairs_within(points: DataFrame, radius: str) -> DataFrame:
    """(slice, a, b, distance) of all pairs a < b within the slice's radius (a column of points, positive)."""
    here = points.select("slice", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col(radius).alias("r"), F.floor(F.col("x") / F.col(radius)).alias("gx"), F.floor(F.col("y") / F.col(radius)).alias("gy"))
    there = _around(points, radius).select("slice", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "gx", "gy")
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return here.join(there, ["slice", "gx", "gy"]).where("a < b").withColumn("distance", d).where("distance > 0 and distance <= r").select("slice", "a", "b", "distance")


def nearest_distance(points: DataFrame) -> DataFrame:
    """Distance to the nearest other point: a grid of about two points a cell, widened until every point has met one.

    A point's nearest is known once it lies within the cell size, for all closer points are in the nine cells.
    """
    box = points.groupBy("slice").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    box = box.where("n > 1").select("slice", F.greatest(F.sqrt((F.col("w") + 1) * (F.col("h") + 1) * 2 / F.col("n")), F.lit(1e-6)).alias("size"))
    todo, done = points.join(box, "slice"), None
    every = todo
    for _ in range(40):
        here = todo.select("slice", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "size", F.floor(F.col("x") / F.col("size")).alias("gx"), F.floor(F.col("y") / F.col("size")).alias("gy"))
        there = _around(every, "size").select("slice", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "gx", "gy")
        d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
        met = here.join(there, ["slice", "gx", "gy"]).where("a != b").groupBy("slice", F.col("a").alias("id"), "size").agg(F.min(d).alias("nearest"))
        found = met.where("nearest <= size").select("slice", "id", "nearest")
        found = cut(found, "nearest")
        done = found if done is None else done.union(found)
        todo = cut(todo.join(found, ["slice", "id"], "left_anti").withColumn("size", F.col("size") * 4), "nearest-left")
        if todo.isEmpty():
            return done
        every = every.join(todo.select("slice").distinct(), "slice", "left_semi").withColumn("size", F.col("size") * 4)
    raise RuntimeError("points too far apart for the grid")


def adaptive_threshold(nearest: DataFrame, multiplier: float = MULTIPLIER, max_edge: float | None = None) -> DataFrame:
    """(slice, threshold): median + m * 1.4826 * MAD of the nearest distances; median * m where the MAD is zero."""
    centre = nearest.groupBy("slice").agg(F.median("nearest").alias("m"))
    spread = nearest.join(centre, "slice").groupBy("slice").agg(F.first("m").alias("m"), F.median(F.abs(F.col("nearest") - F.col("m"))).alias("mad"))
    t = F.when(F.col("mad") > 0, F.col("m") + multiplier * 1.4826 * F.col("mad")).otherwise(F.col("m") * multiplier)
    return spread.select("slice", (t if max_edge is None else F.least(t, F.lit(max_edge))).alias("threshold"))


#: A level's cells are so many times as wide as those of the level before.
WIDEN = 4


def third_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Each pair with the points of the nine cells about its middle, on the grid of its level: all within `size` of the middle are there.

    pairs: (slice, a, b, distance, ax, ay, bx, by, level, size), size being that of the level's cells; points also have
    `levels`, an array of (level, size). A pair's own ends are among the points, for size is at least half its distance.
    """
    cell = lambda c, by: F.floor(c / F.col(by))
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    near = F.explode(F.array(*[F.struct((cell(mx, "size") + i).alias("gx"), (cell(my, "size") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = pairs.select("*", near.alias("g")).select("*", "g.gx", "g.gy").drop("g")
    placed = points.select("slice", F.col("id").alias("c"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.inline("levels"))
    placed = placed.select("slice", "c", "cx", "cy", "level", cell(F.col("cx"), "size").alias("gx"), cell(F.col("cy"), "size").alias("gy"))
    return around.join(placed, ["slice", "level", "gx", "gy"])


def _rims(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs through which some circle holds none of the points met, with the bounds on its centre.

    For a pair and any third point the centres of circles through the pair that leave the point out are a half line on the
    bisector. low and high bound what all half lines have in common, as signed distances from the middle. reach is how far from the middle
    a point not met may be that still refuses the pair: such a point lies outside the circle about the middle, so it bounds the
    centres below 0 or above 0 on its own side, which matters only where high is below 0 or low above 0, and then within that circle.
    """
    t = third_points(pairs, points)
    other = (F.col("c") != F.col("a")) & (F.col("c") != F.col("b"))
    mx, my = F.col("cx") - (F.col("ax") + F.col("bx")) / 2, F.col("cy") - (F.col("ay") + F.col("by")) / 2
    d = (mx * (F.col("ay") - F.col("by")) + my * (F.col("bx") - F.col("ax"))) / F.col("distance")
    w = mx * mx + my * my - F.col("distance") * F.col("distance") / 4
    t = t.withColumns({"d": F.when(other, d), "w": F.when(other, w)})
    side = F.abs("d") > 1e-9 * F.col("distance")
    bound = F.col("w") / (2 * F.col("d"))
    ends = ["ax", "ay", "bx", "by"]
    rim = t.groupBy("slice", "a", "b", "distance", *ends).agg(
        F.max(F.when(side & (F.col("d") < 0), bound)).alias("low"),
        F.min(F.when(side & (F.col("d") > 0), bound)).alias("high"),
        F.min(F.when(~side, F.col("w"))).alias("between"),
    )
    low, high = F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf")))
    ok = (low <= high + 1e-9 * F.col("distance")) & (F.coalesce("between", F.lit(0.0)) >= -1e-9 * F.col("distance") * F.col("distance"))
    reach = lambda t: F.abs(t) + F.sqrt(t * t + F.col("distance") * F.col("distance") / 4)
    needed = F.when(high < 0, reach(high)).when(low > 0, reach(low)).otherwise(F.lit(0.0))
    return rim.where(ok).select("slice", "a", "b", "distance", *ends, ((1 + 1e-9) * needed).alias("reach"))


def delaunay_edges(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs through which some circle holds no other point of the slice.

    Most pairs are refused or settled by points as near as half the longest pair of the slice. For the rest the bounds
    found so far say how far a point may be that still matters: they are tested once more on wider cells, and what is then left once more,
    each on cells as wide as it needs. Both diagonals of four points on one circle stay.
    """
    end = lambda s: points.select("slice", F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    box = points.groupBy("slice").agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("across"))
    # half a pair's distance: the circle about its middle lies within the nine cells (a little more, for its ends lie on the circle)
    grid = pairs.groupBy("slice").agg(((0.5 + 1e-9) * F.max("distance")).alias("cell")).join(box, "slice")
    # at the top level the whole slice lies within the nine cells
    levels = lambda ratio: F.ceil(F.log(ratio) / F.log(F.lit(float(WIDEN)))).cast("int")
    grid = cut(grid.select("slice", "cell", F.greatest(F.lit(2), levels(F.col("across") / F.col("cell")) + 1).alias("top")), "grids")
    size = lambda level: F.col("cell") * F.pow(F.lit(float(WIDEN)), level)
    put = points.select("slice", "id", "x", "y").join(grid, "slice")
    left = pairs.select("slice", "a", "b", "distance").join(end("a"), ["slice", "a"]).join(end("b"), ["slice", "b"])
    needed = F.when(F.col("reach") >= size(F.col("top")), F.col("top")).otherwise(F.greatest(F.lit(2), levels(F.col("reach") / F.col("cell"))))
    out = []
    for level, used in ((F.lit(0), F.array(F.lit(0))), (F.lit(1), F.array(F.lit(1))), (needed, F.sequence(F.lit(2), F.col("top")))):
        tested = left.join(grid, "slice").withColumn("level", level).withColumn("size", size(F.col("level")))
        here = put.withColumn("levels", F.transform(used, lambda n: F.struct(n.alias("level"), size(n).alias("size"))))
        rims = cut(_rims(tested, here).join(grid, "slice").withColumn("settled", F.col("reach") <= size(level)).drop("cell", "top"), "rims")
        out.append(rims.where("settled") if len(out) < 2 else rims)
        left = rims.where(~F.col("settled"))
    return reduce(DataFrame.union, [x.select("slice", "a", "b", "distance") for x in out])


def mutual_knn_edges(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Pairs in which each is among the other's k nearest (ties by id)."""
    both = pairs.select("slice", "a", "b", "distance").unionByName(pairs.select("slice", F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    ranked = both.withColumn("r", F.row_number().over(W.partitionBy("slice", "a").orderBy("distance", "b"))).where(F.col("r") <= k).drop("r")
    back = ranked.select("slice", F.col("a").alias("b"), F.col("b").alias("a"))
    return ranked.where("a < b").join(back, ["slice", "a", "b"], "left_semi")


#: Links of a slice up to which its components are found in one task.
FEW_LINKS = 1 << 20


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that is linked with each of the numbers below n."""
    least = np.arange(n)
    while len(a):
        # hang the greater root below the lesser, then let all numbers point to their roots
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := least[least], least):
            least = up
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    return least


def _slice_components(links: pa.Table) -> pa.Table:
    """(slice, id, component) of all links of a slice."""
    links = links.filter(pc.and_(pc.is_valid(links["a"]), pc.is_valid(links["b"])))
    ends = pa.chunked_array([*links["a"].chunks, *links["b"].chunks], links["a"].type).combine_chunks()
    found = ends.dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[found.indices.to_numpy()]
    names = found.dictionary.take(pa.array(order))
    first = names.take(pa.array(_joined(at[: len(links)], at[len(links) :], len(order))))
    return pa.table({"slice": pa.array([links["slice"][0].as_py() if len(links) else None] * len(order), pa.string()), "id": names, "component": first})


def components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(slice, id, component) of every point with an edge; a component is named by its least id. All slices at once.

    A slice of at most `few` links is one group of a task. For larger ones rounds over tables run over numbers that ascend with
    (slice, id): unlike pairs of texts these are added up by hash.
    """
    ends = cut(edges.select("slice", "a", "b"), "links")
    size = cut(ends.groupBy("slice").agg((F.count("*") > few).alias("large")), "links-large")
    kind = ends.schema["a"].dataType.simpleString()
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ends.join(size.where("not large").select("slice"), "slice", "left_semi").repartition(n, "slice")
    found = own.groupBy("slice").applyInArrow(_slice_components, f"slice string, id {kind}, component {kind}")
    return found.unionByName(_components_by_rounds(ends.join(size.where("large").select("slice"), "slice", "left_semi")))


def _components_by_rounds(ends: DataFrame) -> DataFrame:
    points = ends.select("slice", F.explode(F.array("a", "b")).alias("id")).distinct()
    # numbers ascend from one sorted range to the next; written, so that they stay
    numbered = cut(points.orderBy("slice", "id").select("slice", "id", F.monotonically_increasing_id().alias("n")), "numbered")
    at = lambda c, n: numbered.select("slice", F.col("id").alias(c), F.col("n").alias(n))
    label = connected_components(ends.join(at("a", "u"), ["slice", "a"]).join(at("b", "v"), ["slice", "b"]).select("u", "v"))
    first = numbered.select(F.col("n").alias("component"), F.col("id").alias("first"))
    return label.join(first, "component").join(numbered.withColumnRenamed("n", "node"), "node").select("slice", "id", F.col("first").alias("component"))


def isolated(points: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("slice", F.explode(F.array("a", "b")).alias("id")).distinct()
    return points.select("slice", "id").join(ends, ["slice", "id"], "left_anti")


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen (slice, id)."""
    for end in ("a", "b"):
        edges = edges.join(chosen.select("slice", F.col("id").alias(end)).distinct(), ["slice", end], "left_semi")
    return edges


def connectivity_violations(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """(slice, cluster_id, parts) of the clusters whose points do not hang together."""
    own = assignments.where("cluster_id >= 0")
    label = lambda e: own.select("slice", F.col("id").alias(e), F.col("cluster_id").alias(f"c{e}"))
    inner = edges.join(label("a"), ["slice", "a"]).join(label("b"), ["slice", "b"]).where("ca = cb").select("slice", "a", "b")
    parts = own.join(components(inner), ["slice", "id"], "left").withColumn("part", F.coalesce("component", "id"))
    return parts.groupBy("slice", "cluster_id").agg(F.countDistinct("part").alias("parts")).where("parts > 1")


def graph_audit(points: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    nodes = points.groupBy("slice").agg(F.count("*").alias("nodes"))
    links = edges.groupBy("slice").agg(F.count("*").alias("edges"), F.avg("distance").alias("mean_edge"), F.percentile("distance", 0.95).alias("p95_edge"), F.max("distance").alias("max_edge"))
    parts = labels.groupBy("slice").agg(F.countDistinct("component").alias("linked_parts"), F.count("*").alias("linked"))
    out = nodes.join(links, "slice", "left").join(parts, "slice", "left").na.fill(0, ["edges", "linked_parts", "linked"])
    return out.select("slice", "nodes", "edges", "mean_edge", "p95_edge", "max_edge", (F.col("linked_parts") + F.col("nodes") - F.col("linked")).alias("components"), (F.col("nodes") - F.col("linked")).alias("isolated"), (2 * F.col("edges") / F.col("nodes")).alias("mean_degree"))
