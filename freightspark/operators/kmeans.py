"""K-means by place for all slices, numbers of clusters, weights, seeds and starts in the same DataFrame rounds.

A run is (slice, k, weights, seed, start). Its centres are one row with an array; points are written once in blocks. Where a slice has
at most FEW_POINTS points, a task takes the runs of a kind of weight, seed and start through all their rounds. For larger slices a round
joins the blocks with the runs of their slice, adds up the points of each centre and writes the new centres of all runs. No point
becomes a row for each run: labels stay in arrays beside the points of a block, and what the leaderboard counts is added up by block.
Starting centres are drawn without replacement, in proportion to the weights, by keys from a digest of seed, start and point, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.distances import cluster_facts
from freightspark.functions.order_statistics import values_reaching
from freightspark.functions.shared import cut
from freightspark.operators.zones import pareto_front

RUN = ["slice", "k", "weights", "seed"]
EACH = [*RUN, "start"]
#: Points count alike, or by their trips.
WEIGHTS = ("none", "shipment_count")
MAX_ROUNDS = 300
#: Centres that move by less are settled (metres).
STILL = 1e-6
#: Draws of a run are ranked in groups of about so many points first.
DEALT = 10_000
#: Of a slice of more points than that, those are ranked first whose keys are below what so many times as many draws as wanted reach on average.
LIKELY = 16
#: Points of a block, on average.
BLOCK = 8192
#: Points of a slice up to which a task goes through all rounds of a run, and points that share a box there.
FEW_POINTS, SHARE = 1 << 18, 64
#: Cells of the distances to medoids; only the values of a cell that holds a wanted rank are looked at.
REACHES = 256


def _trips() -> Column:
    return F.greatest(F.coalesce(F.col("trip_count"), F.lit(0)), F.lit(0)).cast("double")


def weighted_points(points: DataFrame, weights: tuple[str, ...] = WEIGHTS) -> DataFrame:
    """(slice, weights, id, x, y, w): each point once for every kind of weight; points of weight 0 are labelled but do not move a centre."""
    trips = _trips()
    if bad := set(weights) - set(WEIGHTS):
        raise ValueError(f"no such weights: {sorted(bad)}")
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("weights"), (F.lit(1.0) if k == "none" else trips).alias("w")) for k in weights]))
    return points.select("slice", "id", "x", "y", each)


def first_centres(points: DataFrame, runs: DataFrame) -> DataFrame:
    """(run..., centres): k points of positive weight drawn by weight. Slices with fewer such points have no run.

    The runs of a seed and start share their draws: each takes as many as it needs.
    """
    draw = ["slice", "weights", "seed", "start"]
    total = points.where("w > 0").groupBy("slice", "weights").agg(F.sum("w").alias("sum"), F.count("*").alias("n"))
    p = points.where("w > 0").join(total, ["slice", "weights"]).join(runs.groupBy(*draw).agg(F.max("k").alias("most")), ["slice", "weights"])
    digest = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("start").cast("string"), F.col("id").cast("string")).cast("binary"))
    key = -F.log((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)) / F.col("w")
    # two rankings, so that no task orders a whole slice
    group = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / DEALT)).alias("group")
    drawn = p.select(*draw, "most", "n", "sum", "id", "x", "y", key.alias("key"), group)
    rank = lambda keys: F.row_number().over(W.partitionBy(*keys).orderBy("key", "id"))

    def least(rows: DataFrame) -> DataFrame:
        some = rows.withColumn("r", rank([*draw, "group"])).where("r <= most")
        return cut(some.withColumn("r", rank(draw)).where("r <= most").select(*draw, "most", "r", "x", "y"), "draws")

    few = least(drawn.where((F.col("n") <= DEALT) | (F.col("key") * F.col("sum") <= LIKELY * F.col("most"))))
    # where weights are so uneven that these do not suffice, all points are ranked
    enough = few.where("r = most").select(*draw)
    short = cut(runs.select(*draw).distinct().join(total.where(F.col("n") > DEALT), ["slice", "weights"], "left_semi").join(enough, draw, "left_anti"), "short-draws")
    if not short.isEmpty():
        few = few.join(short, draw, "left_anti").unionByName(least(drawn.join(short, draw, "left_semi")))
    few = few.join(runs, draw).where("r <= k")
    return few.groupBy(*EACH).agg(F.array_sort(F.collect_list(F.struct("r", "x", "y"))).alias("drawn")).where(F.size("drawn") == F.col("k")).select(*EACH, F.transform("drawn", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("centres"))


def point_blocks(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slice, n, ids, x, y, t): the points of a slice and their trips in arrays, about `block` at a time; n: points of the slice."""
    p = points.select("slice", "id", "x", "y", _trips().alias("t"))
    deal = p.groupBy("slice").agg(F.count("*").alias("n"))
    dealt = p.join(deal, "slice").groupBy("slice", "n", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)).alias("block"))
    blocks = dealt.agg(F.sort_array(F.collect_list(F.struct("id", "x", "y", "t"))).alias("p"))
    return blocks.select("slice", "n", *[F.transform("p", lambda q: q[c]).alias(n) for c, n in (("id", "ids"), ("x", "x"), ("y", "y"), ("t", "t"))])  # noqa: B023


def _weighed(blocks: DataFrame, weights: tuple[str, ...]) -> DataFrame:
    """Blocks once for every kind of weight, with the weights w."""
    each = F.explode(F.array(*map(F.lit, weights))).alias("weights")
    w = F.when(F.col("weights") == WEIGHTS[0], F.transform("t", lambda _: F.lit(1.0))).otherwise(F.col("t"))
    return blocks.select("*", each).withColumn("w", w)


def nearest(x: np.ndarray, y: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, number) of the nearest centre of every point; ties go to the smaller number."""
    least, at = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
    for c, (cx, cy) in enumerate(centres):
        d = (x - cx) ** 2 + (y - cy) ** 2
        near = d < least
        np.copyto(least, d, where=near)
        np.copyto(at, c, where=near)
    return least, at


def _each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(run, ids, w, x, y, squared distances, numbers of the nearest centres) for every block and run of a row."""
    for batch in batches:
        for i in range(batch.num_rows):
            slice_, weights = batch.column("slice")[i].as_py(), batch.column("weights")[i].as_py()
            x, y, w = (batch.column(c)[i].values.to_numpy() for c in ("x", "y", "w"))
            for run in batch.column("runs")[i].as_py():
                centres = np.array([(c["x"], c["y"]) for c in run["centres"]])
                yield (slice_, run["k"], weights, run["seed"], run["start"]), batch.column("ids")[i].values, w, x, y, *nearest(x, y, centres)


#: Types of the columns of EACH.
_KEYS = "slice string, k int, weights string, seed int, start int"


def _repeated(run: tuple, n: int) -> list[pa.Array]:
    return [pa.array([v] * n, pa.string() if isinstance(v, str) else pa.int32()) for v in run]


def _centre_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run, _, w, x, y, d, at in _each_run(batches):
        k = run[1]
        sums = [np.bincount(at, v, minlength=k) for v in (w * x, w * y, w, w * d)]
        yield pa.RecordBatch.from_arrays(_repeated(run, k) + [pa.array(np.arange(k, dtype=np.int32)), *map(pa.array, sums)], names=[*EACH, "c", "sx", "sy", "sw", "cost"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run, ids, _, _, _, _, at in _each_run(batches):
        yield pa.RecordBatch.from_arrays(_repeated(run, len(at)) + [ids, pa.array(at)], names=[*EACH, "id", "cluster_id"])


def _with_runs(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """Every block beside the runs of its slice and kind of weight: as many as there are combinations."""
    own = runs.groupBy("slice", "weights").agg(F.collect_list(F.struct("k", "seed", "start", "centres")).alias("runs"))
    return blocks.join(own, ["slice", "weights"])


def _sums(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """(run..., c, sx, sy, sw, cost): weighted sums of the points nearest to each centre, and of their squared distances."""
    parts = _with_runs(blocks, runs).mapInArrow(_centre_sums, f"{_KEYS}, c int, sx double, sy double, sw double, cost double")
    # by run, for the centres of a run meet next
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, *EACH).groupBy(*EACH, "c").agg(*[F.sum(v).alias(v) for v in ("sx", "sy", "sw", "cost")])


class _Boxes:
    """Points in boxes of SHARE that lie near each other. A box on one side of all bisectors adds its sums to a centre as a whole."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        count = -(-len(x) // SHARE)
        strip = np.empty(len(x), np.int64)
        strip[np.argsort(x, kind="stable")] = np.arange(len(x)) // (SHARE * max(1, round(count**0.5)))
        order = np.lexsort((y, strip))
        # the last box is filled up with a point without weight
        fill = np.append(order, np.full(count * SHARE - len(x), order[-1]))
        self.x, self.y, self.w = (v[fill].reshape(count, SHARE) for v in (x, y, w))
        self.w.reshape(-1)[len(x) :] = 0
        self.low, self.high = (np.stack([f(self.x, 1), f(self.y, 1)], 1) for f in (np.min, np.max))
        self.sums = np.stack([(self.w * self.x).sum(1), (self.w * self.y).sum(1), self.w.sum(1)], 1)

    def centre_sums(self, centres: np.ndarray) -> np.ndarray:
        """(k, 3): weighted sums of x and y and of the weights of the points nearest to each centre; ties go to the smaller number."""
        k, middle = len(centres), (self.low + self.high) / 2
        _, at = nearest(middle[:, 0], middle[:, 1], centres)
        whole = np.ones(len(at), bool)
        for c in range(k):
            # of a box's corners the one farthest towards c
            corner = np.where(centres[c] > centres[at], self.high, self.low)
            own, other = ((corner - centres[at]) ** 2).sum(1), ((corner - centres[c]) ** 2).sum(1)
            whole &= (at == c) | (other - own > 1e-9 * (other + own))
        x, y, w = (v[~whole].ravel() for v in (self.x, self.y, self.w))
        _, near = nearest(x, y, centres)
        return np.stack([np.bincount(at[whole], self.sums[whole, i], k) + np.bincount(near, v, k) for i, v in enumerate((w * x, w * y, w))], 1)


_CENTRES = "centres array<struct<x: double, y: double>>"


def _settle(group: pa.Table) -> pa.Table:
    """The runs of a slice, kind of weight, seed and start after all their rounds. The rows are the blocks of the slice."""
    x, y, w = (group[c].combine_chunks().flatten().to_numpy() for c in ("x", "y", "w"))
    boxes, rows = _Boxes(x, y, w), []
    for run in group["runs"][0].as_py():
        centres, turn, shift = np.array([(c["x"], c["y"]) for c in run["centres"]]), 0, np.inf
        while shift > STILL and turn < MAX_ROUNDS:
            sums, turn = boxes.centre_sums(centres), turn + 1
            weight = sums[:, 2:]
            now = np.where(weight > 0, sums[:, :2] / np.where(weight > 0, weight, 1.0), centres)
            shift, centres = np.abs(now - centres).max(), now
        least, _ = nearest(x, y, centres)
        rows.append({"k": run["k"], "centres": [{"x": cx, "y": cy} for cx, cy in centres.tolist()], "rounds": turn, "cost": float((w * least).sum())})
    own = pa.Table.from_pylist(rows, pa.schema([("k", pa.int32()), ("centres", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("rounds", pa.int32()), ("cost", pa.float64())]))
    for name, kind in (("slice", pa.string()), ("weights", pa.string()), ("seed", pa.int32()), ("start", pa.int32())):
        own = own.append_column(name, pa.array([group[name][0].as_py()] * len(rows), kind))
    return own.select([*EACH, "centres", "rounds", "cost"])


def _settled_in_tasks(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """(run..., centres, rounds, cost) of runs on slices that a task can hold."""
    draw = ["slice", "weights", "seed", "start"]
    own = runs.groupBy(*draw).agg(F.sort_array(F.collect_list(F.struct("k", "centres"))).alias("runs"))
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.select("slice", "weights", "x", "y", "w").join(own, ["slice", "weights"]).repartition(n, *draw)
    return rows.groupBy(*draw).applyInArrow(_settle, f"{_KEYS}, {_CENTRES}, rounds int, cost double")


def _settled_by_rounds(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """(run..., centres, rounds, cost) of runs on slices of any size: a round over tables for all of them."""
    state = cut(runs.withColumns({"rounds": F.lit(0), "moving": F.lit(True)}), "centres")
    for turn in range(1, MAX_ROUNDS + 1):
        sums = _sums(blocks, state.where("moving")).where("sw > 0")
        # at most k entries
        means = sums.groupBy(*EACH).agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct((F.col("sx") / F.col("sw")).alias("x"), (F.col("sy") / F.col("sw")).alias("y"))))).alias("means"))
        moved = F.transform("centres", lambda c, i: F.coalesce(F.element_at("means", i), c))
        shift = F.array_max(F.zip_with("centres", "now", lambda a, b: F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]))))
        now = state.join(means, EACH, "left").withColumn("now", F.when(F.col("moving"), moved).otherwise(F.col("centres")))
        rounds = F.when(F.col("moving"), turn).otherwise(F.col("rounds")).alias("rounds")
        state = cut(now.select(*EACH, F.col("now").alias("centres"), rounds, (F.col("moving") & (shift > STILL)).alias("moving")), "centres", replaces=state)
        if state.where("moving").isEmpty():
            break
    cost = _sums(blocks, state).groupBy(*EACH).agg(F.sum("cost").alias("cost"))
    return state.join(cost, EACH).select(*EACH, "centres", "rounds", "cost")


def best_runs(points: DataFrame, ks: tuple[int, ...], weights: tuple[str, ...] = WEIGHTS, seeds: tuple[int, ...] = (42,), starts: int = 10, few: int = FEW_POINTS) -> tuple[DataFrame, DataFrame]:
    """(blocks, best): the points in blocks, and (slice, k, weights, seed, start, centres, rounds, cost) of each seed's start of least cost (ties: the first)."""
    if min(ks, default=0) < 1 or starts < 1 or not seeds:
        raise ValueError("needs at least one cluster, seed and start")
    p = weighted_points(points, weights)
    lists = {"k": F.array(*map(F.lit, ks)), "seed": F.array(*map(F.lit, seeds)), "start": F.sequence(F.lit(0), F.lit(starts - 1)), "weights": F.array(*map(F.lit, weights))}
    # few rows that hold much: dealt out by number, so that small tables use all cores too
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(point_blocks(points).repartition(n), "kmeans-blocks")
    runs = reduce(lambda df, c: df.withColumn(c, F.explode(lists[c])), lists, blocks.select("slice").distinct())
    runs = cut(first_centres(p, runs), "first-centres")
    each, large = _weighed(blocks, weights), blocks.where(F.col("n") > few).select("slice").distinct()
    done = _settled_in_tasks(each.where(F.col("n") <= few), runs)
    if not large.isEmpty():
        done = done.unionByName(_settled_by_rounds(each.where(F.col("n") > few), runs.join(large, "slice", "left_semi")))
    best = cut(done, "settled").withColumn("r", F.row_number().over(W.partitionBy(*RUN).orderBy("cost", "start"))).where("r = 1").drop("r")
    return blocks, cut(best, "best-runs")


def fits(points: DataFrame, ks: tuple[int, ...], weights: tuple[str, ...] = WEIGHTS, seeds: tuple[int, ...] = (42,), starts: int = 10, few: int = FEW_POINTS) -> DataFrame:
    """(slice, k, weights, seed, id, cluster_id, cost, rounds): of each seed's starts that of least cost (ties: the first)."""
    return _found(*best_runs(points, ks, weights, seeds, starts, few), points.schema["id"].dataType.simpleString())


def _found(blocks: DataFrame, best: DataFrame, kind: str) -> DataFrame:
    labels = _with_runs(_weighed(blocks, WEIGHTS), best).mapInArrow(_labels, f"{_KEYS}, id {kind}, cluster_id int")
    return labels.join(best.select(*EACH, "cost", "rounds"), EACH).select(*RUN, "id", "cluster_id", "cost", "rounds")


def fit_check(points: DataFrame, found: DataFrame) -> DataFrame:
    """(slice, k, weights, seed, points, not_nearest): how many points of a fit are nearer to the mean of another cluster than to that of their own."""
    p = weighted_points(points).join(found, ["slice", "weights", "id"])
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    # at most k means a fit
    means = p.groupBy(*RUN, "cluster_id").agg(mean("x"), mean("y"), F.sum("w").alias("w")).where("w > 0").groupBy(*RUN).agg(F.collect_list(F.struct("cluster_id", "x", "y")).alias("means"))
    away = lambda m: F.sqrt(F.pow(F.col("x") - m["x"], 2) + F.pow(F.col("y") - m["y"], 2))
    own = F.array_min(F.transform(F.filter("means", lambda m: m["cluster_id"] == F.col("cluster_id")), away))
    least = F.array_min(F.transform("means", away))
    # a cluster of points without weight has no mean
    return p.join(means, RUN).groupBy(*RUN).agg(F.count("*").alias("points"), F.count_if(own > least + 1e-3).alias("not_nearest"))


def adjusted_rand(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys..., ari) of two labels of the same rows; 1 where chance alone gives full agreement."""
    return _rand(pairs.groupBy(*keys, left, right).agg(F.count("*").alias("n")), keys, left, right)


def _rand(cells: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """As adjusted_rand, of the numbers n of rows with both labels."""
    both = lambda n: n * (n - 1) / 2.0
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(both(F.col("n"))).alias(name))
    all_ = cells.groupBy(*keys).agg(F.sum(both(F.col("n"))).alias("same"), both(F.sum("n")).alias("every"))
    out = all_.join(side(left, "a"), keys).join(side(right, "b"), keys)
    chance = F.col("a") * F.col("b") / F.nullif(F.col("every"), F.lit(0.0))
    most = (F.col("a") + F.col("b")) / 2
    return out.select(*keys, F.coalesce((F.col("same") - chance) / F.nullif(most - chance, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def _label_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the labels of all runs, in the order of the runs, in place of the centres."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            x, y = (row.column(c)[0].values.to_numpy() for c in ("x", "y"))
            runs = row.column("runs")[0].as_py()
            labels = [nearest(x, y, np.array([(c["x"], c["y"]) for c in run["centres"]]))[1] for run in runs]
            names = pa.array([[{c: run[c] for c in ("k", "weights", "seed")} for run in runs]], pa.list_(pa.struct([("k", pa.int32()), ("weights", pa.string()), ("seed", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("slice", "ids", "x", "y", "t")], names, pa.array([labels], pa.list_(pa.list_(pa.int32())))], names=["slice", "ids", "x", "y", "t", "runs", "labels"])


def labelled_blocks(blocks: DataFrame, best: DataFrame) -> DataFrame:
    """(slice, ids, x, y, t, runs, labels): labels holds an array of the block's points for each of the runs (k, weights, seed)."""
    own = best.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("k", "weights", "seed", "centres"))).alias("runs"))
    kind = blocks.schema["ids"].dataType.simpleString()
    out = f"slice string, ids {kind}, x array<double>, y array<double>, t array<double>, runs array<struct<k: int, weights: string, seed: int>>, labels array<array<int>>"
    return blocks.join(own, "slice").mapInArrow(_label_blocks, out)


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, labels by (k, weights, seed), those of the first seeds by (k, weights)) of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            labels = {(r["k"], r["weights"], r["seed"]): v.values.to_numpy() for r, v in zip(batch.column("runs")[i].as_py(), batch.column("labels")[i], strict=True)}
            # the last that is put in stays: the least seed
            yield batch.slice(i, 1), labels, dict(sorted({(k, w): labels[k, w, s] for k, w, s in sorted(labels, reverse=True)}.items()))


def _numbers(first: dict) -> list[int]:
    """Fits of the first seeds as numbers, as _run_number() has them."""
    return [2 * k + (w != WEIGHTS[0]) for k, w in first]


def _run_number() -> Column:
    return 2 * F.col("k") + F.when(F.col("weights") == WEIGHTS[0], 0).otherwise(1)


_AGREED = pa.schema([("slice", pa.string()), ("k", pa.int32()), ("weights", pa.string()), ("sa", pa.int32()), ("sb", pa.int32()), ("ca", pa.int32()), ("cb", pa.int32()), ("n", pa.int64())])


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of a block by their labels under two seeds, and under two weights (null) of the first seeds."""
    for row, labels, first in _each_block(batches):
        runs = [((k, w, s, t), labels[k, w, s], labels[k, w, t]) for k, w, s in labels for t in {t for *_, t in labels} if s < t and (k, w, t) in labels]
        runs += [((k, None, None, None), first[k, WEIGHTS[0]], first[k, WEIGHTS[1]]) for k, w in first if w == WEIGHTS[0] and (k, WEIGHTS[1]) in first]
        slice_, rows = row.column("slice")[0].as_py(), []
        for run, a, b in runs:
            both = np.bincount(a.astype(np.int64) * (run[0] + 1) + b)
            rows += [(slice_, *run, *divmod(int(c), run[0] + 1), int(both[c])) for c in np.flatnonzero(both)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _AGREED, strict=True)], schema=_AGREED)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a point: its clusters in all fits of the first seeds."""
    lists = lambda v, n: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, n, dtype=np.int32)), pa.array(np.ascontiguousarray(v).ravel(), pa.int32()))
    for row, _, first in _each_block(batches):
        x, y, names = row.column("x")[0].values, row.column("y")[0].values, row.column("ids")[0].values
        cell, ks = np.stack(list(first.values()), 1), np.tile(np.array(_numbers(first), np.int32), (len(x), 1))
        yield pa.RecordBatch.from_arrays([pa.array([row.column("slice")[0].as_py()] * len(x)), names, x, y, lists(ks, len(first)), lists(cell, len(first))], names=["slice", "id", "x", "y", "ks", "cell"])


_REACHED = pa.schema([("slice", pa.string()), ("run", pa.int32()), ("kind", pa.string()), ("cell", pa.int32()), ("n", pa.float64()), ("total", pa.float64()), ("most", pa.float64())])


def _to_medoids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, fit, labels, distances to the medoids, cells of these, trips) for every block and fit."""
    for row, _, first in _each_block(batches):
        x, y, t = (row.column(c)[0].values.to_numpy() for c in ("x", "y", "t"))
        at = {(m["run"], m["cluster_id"]): (m["x"], m["y"]) for m in row.column("medoids")[0].as_py()}
        width = row.column("width")[0].as_py()
        for run, own in zip(_numbers(first), first.values(), strict=True):
            place = np.array([at.get((run, c), (0.0, 0.0)) for c in range(run // 2)])[own]
            # as in SQL: sqrt(dx^2 + dy^2)
            d = np.sqrt((x - place[:, 0]) ** 2 + (y - place[:, 1]) ** 2)
            yield row, run, own, d, np.minimum(d / width, REACHES - 1).astype(np.int32) if width else np.zeros(len(d), np.int32), t


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block adds to each fit: points (n) and trips (t) by cells of distance and by cluster, sums of distances."""
    for row, run, own, d, cell, t in _to_medoids(batches):
        parts = {}
        for kind, w in (("n", np.ones(len(d))), ("t", t)):
            at = np.bincount(cell, w)
            parts[kind] = np.flatnonzero(at), at[at != 0], None, None
            parts[f"{kind}-all"] = np.zeros(1, np.int64), np.array([w.sum()]), np.array([(w * d).sum()]), np.array([d.max()])
        at = np.unique(own)
        parts["cluster"] = at, np.bincount(own)[at].astype(float), np.bincount(own, t)[at], None
        for kind, (at, n, total, most) in parts.items():
            columns = [[row.column("slice")[0].as_py()] * len(at), [run] * len(at), [kind] * len(at), at, n, [None] * len(at) if total is None else total, [None] * len(at) if most is None else most]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REACHED, strict=True)], schema=_REACHED)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distances that lie in the cells wanted of a fit, with their weights. wanted: (run, kind, cell)."""
    for row, run, _, d, cell, t in _to_medoids(batches):
        for want in row.column("wanted")[0].as_py() or ():
            if want["run"] == run:
                w = np.ones(len(d)) if want["kind"] == "n" else t
                at = np.flatnonzero((cell == want["cell"]) & (w > 0))
                yield pa.RecordBatch.from_arrays([pa.array([row.column("slice")[0].as_py()] * len(at)), pa.array([run] * len(at), pa.int32()), pa.array([want["kind"]] * len(at)), pa.array([want["cell"]] * len(at), pa.int32()), pa.array(d[at]), pa.array(w[at])], names=["slice", "run", "kind", "cell", "d", "w"])


def medoid_reaches(wide: DataFrame, medoids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (slice, run, ...) of distances to the medoids, plain and by trips, and of the clusters' sizes and shares of trips.

    wide: labelled_blocks(); medoids: (slice, run, cluster_id, x, y). The p95 are exact: points are counted by cells of distance, and the
    values of the cells that hold a wanted rank are put in order.
    """
    box = wide.groupBy("slice").agg(*[f(g(c)).alias(f"{n}{c}") for c in "xy" for n, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max))])
    box = box.select("slice", (F.sqrt(F.pow(F.col("highx") - F.col("lowx"), 2) + F.pow(F.col("highy") - F.col("lowy"), 2)) / REACHES).alias("width"))
    facts = medoids.groupBy("slice").agg(F.collect_list(F.struct("run", "cluster_id", "x", "y")).alias("medoids")).join(box, "slice")
    placed = wide.select("slice", "x", "y", "t", "runs", "labels").join(cut(facts, "medoid-lists"), "slice")
    found = placed.mapInArrow(_reached, "slice string, run int, kind string, cell int, n double, total double, most double")
    found = cut(found.groupBy("slice", "run", "kind", "cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most")), "reaches")
    # ranks count from 1; of points the two between which the quantile lies, of trips the least that reaches the share
    whole = found.where("kind in ('n-all', 't-all') and n > 0").select("slice", "run", F.substring("kind", 1, 1).alias("kind"), F.col("n").alias("all"))
    place = (F.col("all") - 1) * 0.95
    need = F.inline(F.when(F.col("kind") == "n", F.array(F.struct(F.lit("low").alias("name"), (F.floor(place) + 1).cast("double").alias("need")), F.struct(F.lit("high").alias("name"), (F.ceil(place) + 1).cast("double").alias("need")))).otherwise(F.array(F.struct(F.lit("trips").alias("name"), (F.col("all") * 0.95).alias("need")))))
    ranks = whole.select("slice", "run", "kind", need)
    before = F.coalesce(F.sum("n").over(W.partitionBy("slice", "run", "kind").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    cells = found.where("kind in ('n', 't')").select("slice", "run", "kind", "cell", "n", before.alias("before"))
    hit = cells.join(ranks, ["slice", "run", "kind"]).where("before < need and need <= before + n")
    hit = cut(hit.select("slice", "run", "kind", "cell", "name", (F.col("need") - F.col("before")).alias("need")), "wanted-reaches")
    wanted = hit.select("slice", "run", "kind", "cell").distinct().groupBy("slice").agg(F.collect_list(F.struct("run", "kind", "cell")).alias("wanted"))
    inside = placed.join(wanted, "slice").mapInArrow(_inside, "slice string, run int, kind string, cell int, d double, w double")
    got = values_reaching(inside, ["slice", "run", "kind", "cell"], F.col("d"), F.col("w"), hit)
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    got = got.groupBy("slice", "run").agg(pick("low").alias("low"), pick("high").alias("high"), pick("trips").alias("weighted_p95_m"))
    every = {k: found.where(F.col("kind") == f"{k}-all").select("slice", "run", F.col("n").alias(k), F.col("total").alias(f"d{k}"), F.col("most").alias("max_m")) for k in "nt"}
    reach = every["n"].join(every["t"].drop("max_m"), ["slice", "run"]).join(got, ["slice", "run"])
    part = (F.col("n") - 1) * 0.95 - F.floor((F.col("n") - 1) * 0.95)
    reach = reach.select("slice", "run", "t", (F.col("dn") / F.col("n")).alias("mean_m"), (F.col("dt") / F.nullif("t", F.lit(0.0))).alias("weighted_mean_m"), (F.col("low") * (1 - part) + F.col("high") * part).alias("p95_m"), "weighted_p95_m", "max_m")
    clusters = found.where("kind = 'cluster'").join(reach.select("slice", "run", "t"), ["slice", "run"])
    clusters = clusters.withColumn("share", F.when(F.col("t") > 0, F.col("total") / F.col("t")).otherwise(0.0))
    return reach, clusters.groupBy("slice", "run").agg(
        F.count("*").alias("clusters"), F.min("n").cast("long").alias("min_size"), F.max("n").cast("long").alias("max_size"), F.min("share").alias("min_share"), F.max("share").alias("max_share"),
        F.coalesce(F.stddev_pop("share") / F.nullif(F.avg("share"), F.lit(0.0)), F.lit(0.0)).alias("share_cv"),
    )


def leaderboard(blocks: DataFrame, best: DataFrame) -> DataFrame:
    """A row for each (slice, k, weights): quality of the first seed's fit, stability over seeds, what the weights change, and the Pareto mark.

    blocks, best: see best_runs(). A row is on the front of its slice if no other is as good in stability, silhouette, weighted p95 radius
    and evenness of trips and better in one. Labels stay in arrays by block; counts, sums of silhouettes and least totals come out of each.
    """
    key = ["slice", "k", "weights"]
    wide = cut(labelled_blocks(blocks, best), "labelled-blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    cells = wide.select("slice", "ids", "x", "y", "runs", "labels").mapInArrow(_cells, f"slice string, id {kind}, x double, y double, ks array<int>, cell array<int>")
    cells = cut(cells, "fit-cells")
    # the pairs of a slice meet once for all its fits
    facts = cut(cluster_facts(cells.select("slice", "id", "x", "y"), cells.select("slice", "id", "ks", "cell")), "fit-facts").withColumnRenamed("k", "run")
    silhouette = facts.groupBy("slice", "run").agg(F.when(F.sum("near") > 0, F.sum("s") / F.nullif(F.sum("told"), F.lit(0.0))).alias("silhouette"))
    medoids = facts.groupBy("slice", "run", "cluster_id").agg(F.min(F.struct("total", "id")).alias("m")).select("slice", "run", "cluster_id", F.col("m.id").alias("id"))
    reach, clusters = medoid_reaches(wide, cut(medoids.join(cells.select("slice", "id", "x", "y"), ["slice", "id"]).select("slice", "run", "cluster_id", "x", "y"), "fit-medoids"))
    least = best.groupBy(*key).agg(F.min_by("cost", "seed").alias("cost"), F.countDistinct("seed").alias("stability_runs")).withColumn("run", _run_number().cast("int"))
    km = lambda c, n: (F.col(c) / 1000).alias(n)
    agreed = cut(wide.select("slice", "runs", "labels").mapInArrow(_agreed, "slice string, k int, weights string, sa int, sb int, ca int, cb int, n long").groupBy(*key, "sa", "sb", "ca", "cb").agg(F.sum("n").alias("n")), "agreed")
    stable = _rand(agreed.where("weights is not null"), [*key, "sa", "sb"], "ca", "cb").groupBy(*key).agg(F.avg("ari").alias("mean"), F.min("ari").alias("least"))
    rows = least.join(silhouette, ["slice", "run"]).join(reach, ["slice", "run"]).join(clusters, ["slice", "run"]).join(stable, key, "left")
    rows = rows.select(
        *key, "cost", "clusters", "silhouette", km("mean_m", "mean_radius_km"), km("p95_m", "p95_radius_km"), km("max_m", "max_radius_km"), km("weighted_mean_m", "weighted_mean_radius_km"), km("weighted_p95_m", "weighted_p95_radius_km"),
        F.col("min_size").alias("min_cluster_points"), F.col("max_size").alias("max_cluster_points"), F.col("min_share").alias("min_shipment_share"), F.col("max_share").alias("max_shipment_share"), F.col("share_cv").alias("shipment_share_cv"),
        # every point has a cluster
        F.lit(100.0).alias("point_coverage_pct"), F.when(F.col("t") > 0, 100.0).otherwise(0.0).alias("shipment_coverage_pct"),
        "stability_runs", F.coalesce("mean", F.lit(1.0)).alias("stability_mean_ari"), F.coalesce("least", F.lit(1.0)).alias("stability_min_ari"),
    )
    # equal partitions have equal criteria, in whatever order their sums were added up
    rows = cut(rows.withColumns({c: F.round(c, 9) for c in ("stability_mean_ari", "silhouette", "weighted_p95_radius_km", "shipment_share_cv")}), "leaderboard")
    ari = _rand(agreed.where("weights is null").drop("weights"), ["slice", "k"], "ca", "cb").withColumnRenamed("ari", "weight_sensitivity_ari")
    change = lambda c, n: (F.max(F.when(F.col("weights") == "shipment_count", F.col(c))) - F.max(F.when(F.col("weights") == "none", F.col(c)))).alias(f"weight_sensitivity_{n}")
    deltas = rows.groupBy("slice", "k").agg(change("p95_radius_km", "p95_radius_delta_km"), change("weighted_p95_radius_km", "weighted_radius_delta_km"), change("shipment_share_cv", "shipment_balance_cv_delta"))
    # a criterion without a value is the worst
    ranked = rows.select(*key, F.to_json(F.struct("k", "weights")).alias("run"), *[F.coalesce(c, F.lit(float("-inf"))).alias(c) for c in ("stability_mean_ari", "silhouette")], *[F.coalesce(c, F.lit(float("inf"))).alias(c) for c in ("weighted_p95_radius_km", "shipment_share_cv")])
    front = pareto_front(ranked, ["slice"], ["stability_mean_ari", "silhouette"], ["weighted_p95_radius_km", "shipment_share_cv"], "run")
    front = front.select(*key, F.lit(True).alias("front"))
    out = rows.join(ari, ["slice", "k"], "left").join(deltas, ["slice", "k"], "left").join(front, key, "left")
    return out.withColumn("pareto_shortlist", F.coalesce("front", F.lit(False))).drop("front")


def sweep(points: DataFrame, ks: tuple[int, ...], weights: tuple[str, ...] = WEIGHTS, seeds: tuple[int, ...] = (42, 43, 44, 45, 46), starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """(labels, leaderboard) of all combinations over all slices."""
    blocks, best = best_runs(points, ks, weights, seeds, starts)
    return _found(blocks, best, points.schema["id"].dataType.simpleString()), leaderboard(blocks, best)
