"""Zoning: connected high-cost and high-volume zones, constrained Ward partitions, K sweeps, quality and summaries.

Points are (slice, id, x, y, trip_count, weighted_price, weighted_rub_per_km); edges are (slice, a, b, distance).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.distances import cluster_distances
from freightspark.functions.order_statistics import least_reaching
from freightspark.functions.scalars import relative_delta
from freightspark.functions.shared import cut
from freightspark.operators.economics import weighted_mean
from freightspark.operators.graph import components, induced


def eligible(points: DataFrame, mode: str) -> DataFrame:
    t, p, r = F.col("trip_count") > 0, F.col("weighted_price").isNotNull(), F.col("weighted_rub_per_km").isNotNull()
    rule = {"geography": F.lit(True), "geo_cost": t & p & r, "geo_volume": F.lit(True), "bear_cost": t & r, "bear_volume": t}
    if mode not in rule:
        raise ValueError(f"no mode {mode}")
    return points.where(rule[mode])


def takes_all(mode: str) -> bool:
    """Whether every point is eligible for the mode."""
    return mode in ("geography", "geo_volume")


def high_zones(points: DataFrame, edges: DataFrame, value: str = "weighted_rub_per_km", weight: str | None = "trip_count", zone: float | str = 0.35, single: float = 0.70) -> DataFrame:
    """(slice, id, delta, candidate, cluster_id, cluster_type) of every point. zone: a number, or a column that is the same in all of a slice.

    A candidate exceeds the slice's mean (weighted, or plain without a weight) by `zone`. Linked candidates whose
    pooled mean still does are a zone; a lone candidate above `single` is a zone of its own. Zones count first, by
    their least id, then singletons; all other points have -1.
    """
    if isinstance(zone, float) and not 0 <= zone <= single:
        raise ValueError("thresholds must satisfy 0 <= zone <= single")
    limit = F.lit(zone) if isinstance(zone, float) else F.col(zone)
    mean = (lambda: weighted_mean(F.col(value), F.col(weight))) if weight else (lambda: F.avg(value))
    base = points.groupBy("slice").agg(mean().alias("base"))
    marked = points.join(base, "slice").withColumn("delta", relative_delta(F.col(value), F.col("base"))).withColumn("limit", limit)
    marked = marked.withColumn("candidate", F.coalesce(F.col("delta") >= F.col("limit"), F.lit(False)))
    chosen = marked.where("candidate")
    label = components(induced(edges, chosen))
    own = chosen.join(label, ["slice", "id"], "left")
    pooled = own.where("component is not null").groupBy("slice", "component").agg(mean().alias("zone_mean"), F.first("base").alias("b"), F.first("limit").alias("limit"))
    good = pooled.where(relative_delta(F.col("zone_mean"), F.col("b")) >= F.col("limit")).select("slice", "component")
    zones = own.join(good, ["slice", "component"], "left_semi").select("slice", "id", F.col("component").alias("first_id"), F.lit(0).alias("kind"))
    singles = own.where(F.col("component").isNull() & (F.col("delta") >= single)).select("slice", "id", F.col("id").alias("first_id"), F.lit(1).alias("kind"))
    both = zones.unionByName(singles)
    numbers = both.select("slice", "kind", "first_id").distinct().withColumn("cluster_id", F.row_number().over(W.partitionBy("slice").orderBy("kind", "first_id")) - 1)
    both = both.join(numbers, ["slice", "kind", "first_id"]).select("slice", "id", "cluster_id", F.when(F.col("kind") == 0, "zone").otherwise("singleton").alias("cluster_type"))
    return marked.join(both, ["slice", "id"], "left").select("slice", "id", "delta", "candidate", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "cluster_type")


#: The thresholds that are compared.
THRESHOLDS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.5)


def threshold_sensitivity(points: DataFrame, edges: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, **how) -> DataFrame:
    """What high_zones finds at each threshold, all in one pass: the threshold becomes part of the slice. Facts only, no winner.

    (slice, threshold, candidates, zones, singletons, covered_points, covered_trips, mean_zone_size, max_zone_size).
    """
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    key = lambda df: df.select("*", t).withColumn("slice", F.concat_ws("@", "slice", F.col("threshold").cast("string")))
    p = key(points)
    found = high_zones(p, key(edges).drop("threshold"), zone="threshold", **how).join(p.select("slice", "id", "trip_count"), ["slice", "id"])
    sizes = found.groupBy("slice", "cluster_id", "cluster_type").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("trip_count"), F.lit(0)).alias("trips"), F.sum(F.col("candidate").cast("long")).alias("candidates")
    )
    zone, covered = F.col("cluster_type") == "zone", F.col("cluster_id") >= 0
    out = sizes.groupBy("slice").agg(
        F.sum("candidates").alias("candidates"),
        F.count_if(zone).alias("zones"),
        F.count_if(F.col("cluster_type") == "singleton").alias("singletons"),
        F.coalesce(F.sum(F.when(covered, F.col("n"))), F.lit(0)).alias("covered_points"),
        F.coalesce(F.sum(F.when(covered, F.col("trips"))), F.lit(0)).alias("covered_trips"),
        F.coalesce(F.avg(F.when(zone, F.col("n"))), F.lit(0.0)).alias("mean_zone_size"),
        F.coalesce(F.max(F.when(zone, F.col("n"))), F.lit(0)).alias("max_zone_size"),
    )
    name = F.split("slice", "@")
    return out.withColumn("threshold", F.element_at(name, -1).cast("double")).withColumn("slice", F.array_join(F.slice(name, 1, F.size(name) - 1), "@"))


def robust_scaled(points: DataFrame, columns: list[str]) -> DataFrame:
    """(v - median) / IQR per slice; MAD * 1.4826 where the IQR is zero, 1 where that is too."""
    q = points.groupBy("slice").agg(*[F.percentile(c, [0.25, 0.5, 0.75]).alias(f"q_{c}") for c in columns])
    out = points.join(q, "slice")
    mad = out.groupBy("slice").agg(*[F.median(F.abs(F.col(c) - F.col(f"q_{c}")[1])).alias(f"m_{c}") for c in columns])
    out = out.join(mad, "slice")
    for c in columns:
        iqr, m = F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0], 1.4826 * F.col(f"m_{c}")
        out = out.withColumn(f"s_{c}", (F.col(c) - F.col(f"q_{c}")[1]) / F.when(iqr > 0, iqr).when(m > 0, m).otherwise(1.0))
    return out.drop(*[f"q_{c}" for c in columns], *[f"m_{c}" for c in columns])


def features(points: DataFrame, mode: str, geography: float = 0.7) -> DataFrame:
    """(slice, id, f): the vector that Ward merges by. Geography takes metres as they are; geo_cost and geo_volume weigh scaled place against rate or volume."""
    if mode == "geography":
        return points.select("slice", "id", F.array("x", "y").alias("f"))
    if not 0 < geography < 1:
        raise ValueError("both weights must be positive")
    extra = F.col("weighted_rub_per_km") if mode == "geo_cost" else F.log1p(F.col("trip_count").cast("double"))
    p = points.withColumn("z", extra).where("z is not null")
    s = robust_scaled(p, ["x", "y", "z"])
    g, e = (geography / 2) ** 0.5, (1 - geography) ** 0.5
    return s.select("slice", "id", F.array(F.col("s_x") * g, F.col("s_y") * g, F.col("s_z") * e).alias("f"))


MERGES = "slice string, component string, a string, b string, height double, turn int"
#: Links of a component up to which its merging is finished in one task, and links that a task takes up at once.
FEW_LINKS, BUNDLE = 1 << 20, 1 << 16


def _whole_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about BUNDLE links that hold whole components. Links of a component follow each other."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.num_rows >= BUNDLE:
            last = pc.and_(*[pc.equal(held[c], held[c][-1]) for c in ("slice", "component")])
            start = pc.index(last, True).as_py()
            if start:
                yield held.slice(0, start)
                held = held.slice(start)
    if held is not None and held.num_rows:
        yield held


def _ends(links: pa.Table) -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, a, b, f, n, h): slices and ids of the clusters in ascending order, the places of each link's ends, and the clusters' states."""

    def ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
        found = values.dictionary_encode()
        order = pc.sort_indices(found.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return found.dictionary.take(pa.array(order)), rank[found.indices.to_numpy()]

    slices, at = ranked(links["slice"].combine_chunks())
    ids, ends = ranked(pa.chunked_array([*links["a"].chunks, *links["b"].chunks]).combine_chunks())
    keys, place = np.unique(np.tile(at, 2) * len(ids) + ends, return_inverse=True)
    names = [slices.take(pa.array(keys // len(ids))), ids.take(pa.array(keys % len(ids)))]
    a, b = place[: len(links)], place[len(links) :]
    lists = {e: links[f"f{e}"].combine_chunks() for e in ("a", "b")}
    sizes = {e: pc.list_value_length(v).to_numpy() for e, v in lists.items()}
    # a shorter vector has zeros, which add nothing to a distance
    f, n, h = np.zeros((len(keys), max(s.max() for s in sizes.values()))), np.empty(len(keys)), np.empty(len(keys))
    for rows, e in ((a, "a"), (b, "b")):
        flat, start = lists[e].flatten().to_numpy(), np.cumsum(sizes[e]) - sizes[e]
        for i in range(f.shape[1]):
            has = sizes[e] > i
            f[rows[has], i] = flat[start[has] + i]
        n[rows], h[rows] = links[f"n{e}"].to_numpy(), links[f"h{e}"].to_numpy()
    return names, a, b, f, n, h


def _merge_rounds(links: pa.Table, turn: int) -> Iterator[pa.RecordBatch]:
    """The rounds of ward_merges from `turn` on, over all components of `links`, to the end."""
    names, a, b, f, n, h = _ends(links)
    component = np.empty(len(n), np.int64)
    of = links["component"].combine_chunks().dictionary_encode()
    component[a] = component[b] = of.indices.to_numpy()
    node, log = np.arange(len(n)), []
    while len(a):
        gap = np.zeros(len(a))
        for d in (f[a] - f[b]).T:
            gap += d * d
        cost = n[a] * n[b] / (n[a] + n[b]) * gap
        order = np.lexsort((b, a, cost))
        first = np.full((2, len(node)), len(a))
        for k, end in enumerate((a[order], b[order])):
            first[k, end[::-1]] = np.arange(len(a))[::-1]  # the cheapest link of each cluster
        best = first.min(axis=0)
        agreed = order[(best[a[order]] == np.arange(len(a))) & (best[b[order]] == np.arange(len(a)))]
        x, y = a[agreed], b[agreed]
        height = np.maximum(cost[agreed], np.maximum(h[x], h[y]))
        log.append((node[x], node[y], height, np.full(len(x), turn, np.int32)))
        # the same arithmetic as in rounds over tables
        total = f * n[:, None]
        total[x] += total[y]
        n[x] += n[y]
        f, h[x] = total / n[:, None], height
        into = np.arange(len(node))
        into[y] = x
        a, b = into[a], into[b]
        a, b = np.divmod(np.unique(np.minimum(a, b)[a != b] * len(node) + np.maximum(a, b)[a != b]), len(node))
        left = np.unique(np.append(a, b))
        a, b, node, f, n, h, turn = np.searchsorted(left, a), np.searchsorted(left, b), node[left], f[left], n[left], h[left], turn + 1
    x, y, height, turns = (np.concatenate(c) for c in zip(*log, strict=True))
    columns = [names[0].take(pa.array(x)), of.dictionary.take(pa.array(component[x])), names[1].take(pa.array(x)), names[1].take(pa.array(y))]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(height), pa.array(turns)], names=["slice", "component", "a", "b", "height", "turn"])


def _finished(costs: DataFrame, turn: int) -> DataFrame:
    """The merges from `turn` on of components that are small enough for a task. costs: links with the states of their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in _whole_components(batches):
            yield from _merge_rounds(links, turn)

    n = int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return costs.repartition(n, "slice", "component").sortWithinPartitions("slice", "component").mapInArrow(run, MERGES)


def ward_merges(feats: DataFrame, edges: DataFrame, label: DataFrame | None = None, few: int = FEW_LINKS) -> DataFrame:
    """The merge log of Ward's method along edges: (slice, component, a, b, height, turn); a is the new cluster's name.

    Every round merges all pairs that are each other's cheapest neighbour, in all slices and components at once. Ties go
    to the lesser (a, b). The height never falls along a branch. Components merge apart from each other: one of at most `few` links
    goes through all its rounds in a task, so rounds over tables are for larger ones, until they too have few links left.
    label: (slice, id, component) of the edges, where it is known.
    """
    label = components(edges) if label is None else label
    named = label.withColumnRenamed("id", "a")
    sizes = edges.join(named, ["slice", "a"]).groupBy("slice", "component").agg(F.count("*").alias("links"))
    if sizes.where(F.col("links") > few).isEmpty():
        end = lambda s: feats.select("slice", F.col("id").alias(s), F.col("f").alias(f"f{s}"), F.lit(1.0).alias(f"n{s}"), F.lit(0.0).alias(f"h{s}"))
        return cut(_finished(edges.select("slice", "a", "b").join(end("a").join(named, ["slice", "a"]), ["slice", "a"]).join(end("b"), ["slice", "b"]), 0), "ward-merge")
    state = cut(feats.join(label, ["slice", "id"]).select("slice", "component", "id", "f", F.lit(1.0).alias("n"), F.lit(0.0).alias("h")), "ward-state")
    link = cut(induced(edges, feats).join(label.withColumnRenamed("id", "a"), ["slice", "a"]).select("slice", "component", "a", "b"), "ward-link")
    log = None
    for turn in range(200):
        end = lambda s: state.select("slice", F.col("id").alias(s), F.col("f").alias(f"f{s}"), F.col("n").alias(f"n{s}"), F.col("h").alias(f"h{s}"))  # noqa: B023, E731
        both = link.join(end("a"), ["slice", "a"]).join(end("b"), ["slice", "b"])
        large = cut(link.groupBy("slice", "component").agg(F.count("*").alias("links")).where(F.col("links") > few).select("slice", "component"), "ward-large")
        done = cut(_finished(both.join(large, ["slice", "component"], "left_anti"), turn), "ward-merge")
        log = done if log is None else log.unionByName(done)
        if large.isEmpty():
            return log
        gap = F.aggregate(F.zip_with("fa", "fb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
        cost = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * gap
        costs = both.join(large, ["slice", "component"], "left_semi").select("slice", "component", "a", "b", cost.alias("cost"), F.greatest(cost, F.col("ha"), F.col("hb")).alias("height"))
        pick = F.min(F.struct("cost", "a", "b")).alias("best")
        best = costs.select("slice", F.explode(F.array("a", "b")).alias("id"), "cost", "a", "b").groupBy("slice", "id").agg(pick)
        agreed = best.groupBy("slice", "best").agg(F.count("*").alias("k")).where("k = 2").select("slice", "best.a", "best.b")
        merges = cut(costs.join(agreed, ["slice", "a", "b"]).select("slice", "component", "a", "b", "height", F.lit(turn).alias("turn")), "ward-merge")
        log = log.unionByName(merges)
        to = merges.select("slice", F.col("b").alias("id"), F.col("a").alias("into"), "height")
        moved = state.join(large, ["slice", "component"], "left_semi").join(to.select("slice", "id", "into"), ["slice", "id"], "left")
        own = merges.select("slice", F.col("a").alias("id"), "height")
        grouped = moved.withColumn("id", F.coalesce("into", "id")).groupBy("slice", "component", "id").agg(
            F.sum("n").alias("n"), *[(F.sum(F.get("f", F.lit(i)) * F.col("n")) / F.sum("n")).alias(f"f{i}") for i in range(3)], F.max("h").alias("h")
        )
        merged = grouped.join(own, ["slice", "id"], "left")
        f = F.array_compact(F.array("f0", "f1", "f2"))
        state = cut(merged.select("slice", "component", "id", f.alias("f"), "n", F.greatest("h", F.coalesce("height", F.lit(0.0))).alias("h")), "ward-state", replaces=state)
        before = link
        link = link.join(large, ["slice", "component"], "left_semi")
        for e in ("a", "b"):
            link = link.join(to.select("slice", F.col("id").alias(e), F.col("into").alias(f"i{e}")), ["slice", e], "left").withColumn(e, F.coalesce(f"i{e}", e)).drop(f"i{e}")
        link = cut(link.where("a != b").select("slice", "component", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ward-link", replaces=before)
    raise RuntimeError("Ward merging did not end")


def seats(sizes: DataFrame, k: DataFrame) -> DataFrame:
    """(slice, k, component, clusters): k clusters shared among a slice's components (size > 1) by highest averages.

    One each, then the greatest size / (clusters + 1), ties to the larger, then the lesser component; never more than
    the size. The quotients that win are the k - m greatest of size / j, j = 2 .. size.
    """
    base = sizes.join(k, "slice")
    m = base.groupBy("slice", "k").agg(F.count("*").alias("m"))
    quotients = base.join(m, ["slice", "k"]).where("size > 1").select("slice", "k", "component", "size", "m", F.explode(F.sequence(F.lit(2).cast("long"), F.least("size", F.col("k").cast("long") + 1))).alias("j"))
    rank = F.row_number().over(W.partitionBy("slice", "k").orderBy(F.desc(F.col("size") / F.col("j")), F.desc("size"), "component"))
    won = quotients.withColumn("r", rank).where(F.col("r") <= F.col("k") - F.col("m")).groupBy("slice", "k", "component").agg(F.count("*").alias("extra"))
    return base.join(won, ["slice", "k", "component"], "left").select("slice", "k", "component", (1 + F.coalesce("extra", F.lit(0))).alias("clusters"), "size")


def cut_partitions(log: DataFrame, label: DataFrame, k: DataFrame) -> DataFrame:
    """(slice, k, id, cluster_id) for every K of (slice, k) from one merge log: each component keeps its size - clusters lowest merges.

    A component that is one cluster keeps its name; only those that are divided are put together again from their merges.
    """
    sizes = label.groupBy("slice", "component").agg(F.count("*").alias("size"))
    share = cut(seats(sizes, k), "seats")
    divided = share.where("clusters > 1")
    ranked = log.join(divided.select("slice", "component").distinct(), ["slice", "component"], "left_semi")
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("slice", "component").orderBy("height", "turn", "a", "b")))
    kept = ranked.join(divided, ["slice", "component"]).where(F.col("r") <= F.col("size") - F.col("clusters"))
    key = F.concat_ws("@", "slice", F.col("k").cast("string"))
    parts = components(kept.select(key.alias("slice"), "a", "b")).select(F.col("slice").alias("key"), "id", F.col("component").alias("part"))
    points = label.join(share.select("slice", "k", "component", "clusters"), ["slice", "component"]).withColumn("key", key)
    whole = points.where("clusters = 1").select("slice", "k", "id", F.col("component").alias("part"))
    out = points.where("clusters > 1").join(parts, ["key", "id"], "left").select("slice", "k", "id", F.coalesce("part", "id").alias("part")).unionByName(whole)
    numbers = out.select("slice", "k", "part").distinct().withColumn("cluster_id", F.dense_rank().over(W.partitionBy("slice", "k").orderBy("part")) - 1)
    return out.join(numbers, ["slice", "k", "part"]).select("slice", "k", "id", "cluster_id")


def k_range(label: DataFrame, most: int = 20) -> DataFrame:
    """(slice, k) from the number of components (at least 2) to the least of `most` and points - 1.

    Where that range is empty, k is the number of components, or 2 if that is more and there are two points.
    """
    s = label.groupBy("slice").agg(F.countDistinct("component").alias("m"), F.count("*").alias("n"))
    s = s.select("slice", F.greatest(F.lit(2), F.col("m")).cast("int").alias("low"), F.least(F.lit(most), F.col("n") - 1).cast("int").alias("high"), F.greatest("m", F.least("n", F.lit(2))).cast("int").alias("only"))
    ks = F.when(F.col("low") <= F.col("high"), F.sequence("low", F.greatest("low", "high"))).otherwise(F.array("only"))
    return s.select("slice", F.explode(ks).alias("k"))


def _gap(x: str, y: str, u: str, v: str) -> Column:
    return F.sqrt(F.pow(F.col(x) - F.col(u), 2) + F.pow(F.col(y) - F.col(v), 2))


def partition_quality(points: DataFrame, assigned: DataFrame, far: DataFrame | None = None) -> DataFrame:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin of each (slice, k), size diagnostics, radii to the medoids and the spread of a value.

    Points may hold `value` and `weight`: mad is the mean absolute deviation of the value from its cluster's mean, both
    weighted. The first three are null where every point is a cluster. Each pair of a slice meets once, whatever the number of K.
    far: the distances, where they are known.
    """
    if "value" not in points.columns:
        points = points.withColumns({"value": F.lit(None).cast("double"), "weight": F.lit(1.0)})
    p = cut(assigned.select("slice", "k", "id", "cluster_id").join(points.select("slice", "id", "x", "y", "value", "weight"), ["slice", "id"]), "quality-points")
    far = cut(cluster_distances(points, assigned), "cluster-distances") if far is None else far
    wider = F.greatest("a", "b")
    s = far.select("slice", "k", F.when(F.col("a").isNull() | (wider == 0), 0.0).otherwise((F.col("b") - F.col("a")) / wider).alias("s"), "a")
    silhouette = s.groupBy("slice", "k").agg(F.when(F.count("a") > 0, F.avg("s")).alias("silhouette"))
    # the medoid has the least total distance in its cluster; a lone point has no pairs
    inner = p.join(far.select("slice", "k", "id", "total"), ["slice", "k", "id"], "left")
    first = F.min(F.struct(F.coalesce("total", F.lit(0.0)).alias("total"), "id", "x", "y")).alias("m")
    medoid = inner.groupBy("slice", "k", "cluster_id").agg(first).select("slice", "k", "cluster_id", F.col("m.x").alias("medoid_x"), F.col("m.y").alias("medoid_y"))
    centre = p.groupBy("slice", "k", "cluster_id").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"), weighted_mean(F.col("value"), F.col("weight")).alias("mean_value")
    )
    whole = p.groupBy("slice", "k").agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"), F.count("*").alias("points"))
    both = p.join(centre, ["slice", "k", "cluster_id"]).join(medoid, ["slice", "k", "cluster_id"])
    r, reach = _gap("x", "y", "mx", "my"), _gap("x", "y", "medoid_x", "medoid_y")
    both = both.withColumns({"r": r, "reach": reach, "off": F.abs(F.col("value") - F.col("mean_value"))})
    radii = both.groupBy("slice", "k").agg(
        F.avg("reach").alias("mean_radius_m"), F.percentile("reach", 0.95).alias("p95_radius_m"), F.max("reach").alias("max_radius_m"), weighted_mean(F.col("off"), F.col("weight")).alias("mad")
    )
    inside = both.groupBy("slice", "k", "cluster_id").agg(F.sum(F.col("r") * F.col("r")).alias("w"), F.avg("r").alias("spread"))
    c = cut(centre.join(inside, ["slice", "k", "cluster_id"]).join(whole, ["slice", "k"]), "centres")
    b2 = F.col("n") * (F.pow(F.col("mx") - F.col("gx"), 2) + F.pow(F.col("my") - F.col("gy"), 2))
    sums = c.groupBy("slice", "k").agg(
        (F.sum(b2) / F.nullif(F.count("*") - 1, F.lit(0)) / F.nullif(F.sum("w") / F.nullif(F.first("points") - F.count("*"), F.lit(0)), F.lit(0.0))).alias("calinski_harabasz"),
        F.sum((F.col("n") <= 2).cast("long")).alias("tiny_clusters"),
        F.avg((F.col("n") <= 2).cast("double")).alias("tiny_share"),
        (F.stddev_pop("n") / F.avg("n")).alias("size_cv"),
        F.count("*").alias("clusters"),
        F.first("points").alias("points"),
    )
    o = c.select("slice", "k", F.col("cluster_id").alias("oc"), F.col("mx").alias("ox"), F.col("my").alias("oy"), F.col("spread").alias("os"))
    worst = c.join(o, ["slice", "k"]).where("cluster_id != oc").groupBy("slice", "k", "cluster_id").agg(F.max((F.col("spread") + F.col("os")) / _gap("mx", "my", "ox", "oy")).alias("r"))
    db = worst.groupBy("slice", "k").agg(F.avg("r").alias("davies_bouldin"))
    out = sums.join(radii, ["slice", "k"]).join(silhouette, ["slice", "k"], "left").join(db, ["slice", "k"], "left")
    return out.withColumn("davies_bouldin", F.when(F.col("calinski_harabasz").isNotNull(), F.col("davies_bouldin")))


def selection_score(quality: DataFrame, geography: float = 0.7) -> DataFrame:
    """Adds selection_score: silhouette and evenness of the value, each scaled to 0..1 over a slice's K, less what many and tiny clusters cost."""
    w = W.partitionBy("slice")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high > low, (F.coalesce(F.col(c), F.lit(0.0)) - low) / (high - low))

    good, even = F.coalesce(scaled("silhouette"), F.lit(1.0)), F.coalesce(1 - scaled("mad"), F.lit(1.0))
    score = geography * good + (1 - geography) * even - 0.10 * F.col("k") / F.col("points") - 0.20 * F.col("tiny_share")
    return quality.withColumn("selection_score", score)


def select_k(quality: DataFrame, measure: str = "silhouette", tolerance: float = 0.02) -> DataFrame:
    """Adds pareto, eligible and selected: undominated on five criteria, fewest tiny clusters, near the best, least K."""
    low = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    excess = F.col("k") / F.max("k").over(W.partitionBy("slice"))
    q = quality.withColumn("penalty", excess)
    crit = [(-F.coalesce(F.col("silhouette"), F.lit(float("-inf")))), low("p95_radius_m"), low("tiny_share"), low("size_cv"), low("penalty")]
    q = q.withColumn("c", F.array(*crit))
    other = q.select("slice", F.col("k").alias("ok"), F.col("c").alias("oc"))
    le = F.forall(F.zip_with("oc", "c", lambda x, y: x <= y), lambda v: v)
    lt = F.exists(F.zip_with("oc", "c", lambda x, y: x < y), lambda v: v)
    beaten = q.join(other, "slice").where((F.col("ok") != F.col("k")) & le & lt).select("slice", "k").distinct().withColumn("beaten", F.lit(True))
    q = q.join(beaten, ["slice", "k"], "left").withColumn("pareto", F.col("beaten").isNull()).drop("beaten", "c", "penalty")
    w = W.partitionBy("slice")
    tiny = F.min(F.when(F.col("pareto"), F.col("tiny_clusters"))).over(w)
    q = q.withColumn("sane", F.col("pareto") & (F.col("tiny_clusters") == tiny))
    best = F.max(F.when(F.col("sane"), F.col(measure))).over(w)
    q = q.withColumn("eligible", F.col("sane") & (best.isNull() | F.coalesce(F.col(measure) >= best - tolerance, F.lit(False)))).drop("sane")
    return q.withColumn("selected", F.col("eligible") & (F.col("k") == F.min(F.when(F.col("eligible"), F.col("k"))).over(w)))


def pareto_front(df: DataFrame, keys: list[str], maximize: list[str], minimize: list[str], ident: str) -> DataFrame:
    """Rows of each group that no other row beats on all criteria."""
    c = [*[-F.col(x) for x in maximize], *[F.col(x) for x in minimize]]
    q = df.withColumn("_c", F.array(*c))
    o = q.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(ident).alias("_i"), F.col("_c").alias("_o"))
    le, lt = F.forall(F.zip_with("_o", "_c", lambda x, y: x <= y), lambda v: v), F.exists(F.zip_with("_o", "_c", lambda x, y: x < y), lambda v: v)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return q.join(o, same & (F.col(ident) != F.col("_i")) & le & lt, "left_anti").drop("_c")


def summarize(points: DataFrame, assigned: DataFrame, far: DataFrame | None = None) -> DataFrame:
    """Per cluster: counts, share of points, centroid, medoid (least total distance, then least id), economics, radii in km.

    far: (slice, id, total) of the points within their clusters, where it is known.
    """
    p = points.join(assigned.where("cluster_id >= 0").select("slice", "id", "cluster_id"), ["slice", "id"])
    if far is None:
        # each cluster is a slice of its own here: distances are within clusters only
        one = cut(p.select(F.to_json(F.struct("slice", "cluster_id")).alias("run"), "slice", "cluster_id", "id", "x", "y"), "clusters")
        alone = one.select(F.col("run").alias("slice"), F.lit(0).alias("k"), "id", F.lit(0).alias("cluster_id"))
        total = cluster_distances(one.select(F.col("run").alias("slice"), "id", "x", "y"), alone).select(F.col("slice").alias("run"), "id", "total")
        within = one.join(total, ["run", "id"])
    else:
        within = p.select("slice", "cluster_id", "id").join(far.select("slice", "id", "total"), ["slice", "id"])
    medoid = within.groupBy("slice", "cluster_id").agg(F.min(F.struct("total", "id")).alias("m")).select("slice", "cluster_id", F.col("m.id").alias("medoid"))
    medoid = cut(medoid, "medoids")
    at = p.select("slice", F.col("id").alias("medoid"), F.col("x").alias("mx"), F.col("y").alias("my"))
    r = F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)) / 1000
    own = p.join(medoid, ["slice", "cluster_id"]).join(at, ["slice", "medoid"]).withColumn("r", r)
    total = points.groupBy("slice").agg(F.count("*").alias("all_points"))
    out = own.groupBy("slice", "cluster_id", "medoid").agg(
        F.count("*").alias("points"), F.sum("trip_count").alias("trips"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        weighted_mean(F.col("weighted_price"), F.col("trip_count")).alias("weighted_price"), weighted_mean(F.col("weighted_rub_per_km"), F.col("trip_count")).alias("weighted_rub_per_km"),
        F.avg("r").alias("mean_radius_km"), F.percentile("r", 0.95).alias("p95_radius_km"), F.max("r").alias("max_radius_km"),
    )
    return out.join(total, "slice").withColumn("point_share", F.col("points") / F.col("all_points")).drop("all_points")


def compactness(points: DataFrame, assigned: DataFrame, far: DataFrame | None = None) -> DataFrame:
    """One row a slice: coverage, noise, distances to the medoids (plain and by trips), cluster sizes and shares of trips. far: see summarize."""
    trips = F.greatest(F.coalesce("trip_count", F.lit(0)), F.lit(0))
    label = assigned.where("cluster_id >= 0").select("slice", "id", "cluster_id")
    p = points.join(label, ["slice", "id"], "left").withColumn("t", trips)
    table = summarize(points, assigned, far)
    at = points.select("slice", F.col("id").alias("medoid"), F.col("x").alias("mx"), F.col("y").alias("my"))
    medoid = table.select("slice", "cluster_id", "medoid").join(at, ["slice", "medoid"]).drop("medoid")
    own = p.where("cluster_id >= 0").join(medoid, ["slice", "cluster_id"]).withColumn("d", _gap("x", "y", "mx", "my"))
    whole = p.groupBy("slice").agg(F.count("*").alias("points"), F.count("cluster_id").alias("assigned"), F.sum("t").alias("trips"), F.sum(F.when(F.col("cluster_id") >= 0, F.col("t"))).alias("assigned_trips"))
    reach = own.groupBy("slice").agg(
        F.avg("d").alias("mean_m"), (F.sum(F.col("d") * F.col("t")) / F.nullif(F.sum("t"), F.lit(0))).alias("weighted_mean_m"), F.percentile("d", 0.95).alias("p95_m"), F.max("d").alias("max_m")
    )
    tail = weighted_percentile(own, ["slice"], "d", "t", 0.95).withColumnRenamed("weighted_percentile", "weighted_p95_m")
    clusters = own.groupBy("slice", "cluster_id").agg(F.count("*").alias("n"), F.sum("t").alias("t")).join(whole.select("slice", "trips"), "slice")
    clusters = clusters.withColumn("share", F.when(F.col("trips") > 0, F.col("t") / F.col("trips")).otherwise(0.0))
    shares = clusters.groupBy("slice").agg(
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.coalesce(F.stddev_pop("share") / F.nullif(F.avg("share"), F.lit(0.0)), F.lit(0.0)).alias("share_cv")
    )
    out = whole.join(reach, "slice", "left").join(tail, "slice", "left").join(shares, "slice", "left")
    return out.select(
        "slice", (100 * F.col("assigned") / F.col("points")).alias("coverage_pct"), (100 - 100 * F.col("assigned") / F.col("points")).alias("noise_pct"),
        F.coalesce(100 * F.col("assigned_trips") / F.nullif(F.col("trips"), F.lit(0)), F.lit(0.0)).alias("trip_coverage_pct"),
        "mean_m", "weighted_mean_m", "p95_m", "weighted_p95_m", "max_m", F.coalesce("min_size", F.lit(0)).alias("min_size"), F.coalesce("max_size", F.lit(0)).alias("max_size"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min_share", "max_share", "share_cv")],
    )


def spread_metrics(points: DataFrame, assigned: DataFrame, value: str, weight: str | None) -> DataFrame:
    """One row a slice: how a value spreads within and between the clusters; weighted for rates, plain for volumes.

    Between clusters, deviations from the slice's mean count by the clusters' weights (each cluster once without a weight).
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = points.select("slice", "id", F.col(value).cast("double").alias("v"), w.alias("w"))
    own = p.join(assigned.where("cluster_id >= 0").select("slice", "id", "cluster_id"), ["slice", "id"])
    v, w = F.col("v"), F.col("w")
    mean = weighted_mean(v, w)
    clusters = own.groupBy("slice", "cluster_id").agg(mean.alias("m"), (F.sum("w") if weight else F.lit(1.0)).alias("cw"))
    whole = p.groupBy("slice").agg(mean.alias("slice_mean"))
    inside = own.join(clusters, ["slice", "cluster_id"]).groupBy("slice").agg(weighted_mean(F.abs(v - F.col("m")), w).alias("within_mad"), weighted_mean(F.pow(v - F.col("m"), 2), w).alias("within_variance"))
    between = clusters.join(whole, "slice").groupBy("slice").agg(
        weighted_mean(F.pow(F.col("m") - F.col("slice_mean"), 2), F.col("cw")).alias("between_variance"), (F.max("m") - F.min("m")).alias("spread")
    )
    out = whole.join(inside, "slice").join(between, "slice")
    return out.withColumn("variance_ratio", F.when(F.col("within_variance") > 1e-9, F.col("between_variance") / F.col("within_variance")))


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, fraction: float) -> DataFrame:
    """Least value whose cumulative weight reaches the fraction of the total; positive weights only."""
    return least_reaching(df, keys, F.col(value), F.col(weight), fraction, "weighted_percentile")


def point_status(assigned: Column, kind: Column, candidate: Column, isolated: Column, unavailable: Column) -> Column:
    return F.when(unavailable, "unavailable").when(assigned >= 0, F.coalesce(kind, F.lit("cluster"))).when(candidate, "candidate").when(isolated, "spatial_outlier").otherwise("ordinary")


#: The codes of the warnings.
WARNINGS = ("CONTAINS_FORECAST", "MIXED_ECONOMIC_SEGMENTS", "COORDINATE_INCOMPLETE", "ECONOMIC_UNAVAILABLE")


def warnings(forecast: Column, mixed: Column, unresolved: Column, unavailable: Column) -> Column:
    """Codes of what a reader of a result should know, in the order of WARNINGS."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in zip((forecast, mixed, unresolved, unavailable), WARNINGS, strict=True)]))


def assignment_coverage(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per slice: points without an assignment and assignments without a point; both must be none."""
    p, a = (df.select("slice", "id").distinct() for df in (points, assigned))
    gone = p.join(a, ["slice", "id"], "left_anti").select("slice", F.lit(1).alias("missing"), F.lit(0).alias("extra"))
    more = a.join(p, ["slice", "id"], "left_anti").select("slice", F.lit(0).alias("missing"), F.lit(1).alias("extra"))
    every = p.select("slice").union(a.select("slice")).distinct().select("slice", F.lit(0).alias("missing"), F.lit(0).alias("extra"))
    return gone.union(more).union(every).groupBy("slice").agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


def slice_stability(assigned: DataFrame) -> DataFrame:
    """Agreement of each pair of slices, by mode, on the points that both assign. assigned: (mode, slice, id, cluster_id)."""
    own = assigned.where("cluster_id >= 0")
    left = own.select("mode", F.col("slice").alias("left_slice"), "id", F.col("cluster_id").alias("l"))
    right = own.select("mode", F.col("slice").alias("right_slice"), "id", F.col("cluster_id").alias("r"))
    return _agreement(left.join(right, ["mode", "id"]).where("left_slice < right_slice"), ["mode", "left_slice", "right_slice"])


def candidate_recurrence(assigned: DataFrame) -> DataFrame:
    """(mode, id, share): in which share of a mode's slices a point lies in a zone or is a singleton."""
    total = assigned.groupBy("mode").agg(F.countDistinct("slice").alias("slices"))
    own = assigned.where("cluster_id >= 0").groupBy("mode", "id").agg(F.countDistinct("slice").alias("n"))
    return own.join(total, "mode").select("mode", "id", (F.col("n") / F.col("slices")).alias("share"))


def membership_agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two assignments on points that both assign."""
    own = lambda df, name: df.where("cluster_id >= 0").select(*keys, "id", F.col("cluster_id").alias(name))
    return _agreement(own(a, "l").join(own(b, "r"), [*keys, "id"]), keys)


def _agreement(both: DataFrame, keys: list[str]) -> DataFrame:
    cells = both.groupBy(*keys, "l", "r").agg(F.count("*").cast("double").alias("n"))
    pair = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    log = lambda c: F.sum(F.col(c) * F.log(c))
    side = lambda s, t: cells.groupBy(*keys, s).agg(F.sum("n").alias("n")).groupBy(*keys).agg(pair("n").alias(f"p{t}"), log("n").alias(f"e{t}"))
    out = cells.groupBy(*keys).agg(pair("n").alias("p"), log("n").alias("e"), F.sum("n").alias("n"))
    out = (out.join(side("l", "l"), keys).join(side("r", "r"), keys)) if keys else out.crossJoin(side("l", "l")).crossJoin(side("r", "r"))
    n = F.col("n")
    expected, best = F.col("pl") * F.col("pr") / (n * (n - 1) / 2), (F.col("pl") + F.col("pr")) / 2
    ari = F.when(n < 2, None).when(best == expected, 1.0).otherwise((F.col("p") - expected) / (best - expected))
    h = lambda e: F.log(n) - F.col(e) / n
    info, mean = h("el") + h("er") - h("e"), (h("el") + h("er")) / 2
    return out.select(*keys, n.alias("points"), ari.alias("ari"), F.when(n < 2, None).when(mean <= 1e-12, 1.0).otherwise(info / mean).alias("nmi"))
