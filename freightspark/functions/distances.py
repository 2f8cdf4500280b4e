"""Sums of distances from every point of a slice to the clusters of the slice's partitions, in bounded blocks.

A slice's points are dealt into blocks along a curve that keeps near points together; each block is one group that all blocks of its slice go through, so
a task holds two blocks and the sums of its own block's points. No pair becomes a row. Blocks are halved down to boxes of at most LEAF points. Between
boxes that lie apart the distance is interpolated on NODES x NODES Chebyshev points of either box (relative error of a sum below 1e-9), so that far
boxes meet at the cost of these points; boxes near each other meet point by point. Sums are kept for each finest cluster where these are
few. Where one partition has many clusters, each cluster belongs to a bucket of about a block of points: once a bucket has gone through,
only the least mean of its clusters is kept. Where several partitions have many, blocks are as much smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.shared import cut

#: Points of a block, on average, and pairs of points that are compared at once.
BLOCK, PAIRS = 8192, 1 << 16
#: Points of a box that is not halved any more, and Chebyshev points to a side of a box.
LEAF, NODES = 512, 12
#: Cells to a side of a slice's box, a power of two.
SIDE = 64
#: Finest clusters of a slice, up to which all their sums are kept for a whole block.
FEW = 256


_T = np.cos(np.outer(np.arange(NODES), (np.arange(NODES) + 0.5) * np.pi / NODES))
_CARDINAL = np.where(np.arange(NODES)[:, None] == 0, 1.0, 2.0) / NODES * _T


class _Box:
    """Points lo to hi of a block and the halves of their box; points of a leaf ascend by finest cluster."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fine: np.ndarray, order: np.ndarray, lo: int, hi: int):
        """Puts order[lo:hi], places in x, y and fine, in the order of the boxes."""
        own = order[lo:hi]
        self.lo, self.hi, self.kids, self.basis, self.sums = lo, hi, (), None, None
        sides = [(v[own].min(), v[own].max()) for v in (x, y)]
        self.middle, self.half = np.array([(a + b) / 2 for a, b in sides]), np.array([(b - a) / 2 for a, b in sides])
        if hi - lo > LEAF:
            middle, across = (hi - lo) // 2, (x, y)[int(self.half[1] > self.half[0])]
            order[lo:hi] = own[np.argpartition(across[own], middle)]
            self.kids = (_Box(x, y, fine, order, lo, lo + middle), _Box(x, y, fine, order, lo + middle, hi))
        else:
            order[lo:hi] = own[np.argsort(fine[own], kind="stable")]

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        x, y = (m + h * _T[1] for m, h in zip(self.middle, self.half, strict=True))
        return np.repeat(x, NODES), np.tile(y, NODES)

    def sides(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of every point the weights of the Chebyshev points to either side."""
        at = [np.clip((v[self.lo : self.hi] - m) / (h or 1.0), -1, 1) for v, m, h in zip((x, y), self.middle, self.half, strict=True)]
        return [np.cos(np.arccos(v)[:, None] * np.arange(NODES)) @ _CARDINAL for v in at]

    def weights(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(points, nodes): what each point takes from a function's values at the nodes."""
        if self.basis is None:
            a, b = self.sides(x, y)
            self.basis = (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)
        return self.basis

    def moments(self, x: np.ndarray, y: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(finest clusters, sums of their points' weights of each node)."""
        if self.sums is None:
            a, b = self.sides(x, y)
            starts = np.flatnonzero(np.diff(fine[self.lo : self.hi], prepend=-1))
            names, at = np.unique(fine[self.lo : self.hi][starts], return_inverse=True)
            sums = np.zeros((len(names), NODES, NODES))
            for c, i, j in zip(at, starts, np.append(starts[1:], self.hi - self.lo), strict=True):
                sums[c] += a[i:j].T @ b[i:j]
            self.sums = names, sums.reshape(len(names), -1)
        return self.sums

    def apart(self, other: _Box) -> bool:
        """Whether either box's middle is three halves of its greater side from the other box."""
        gap = np.abs(self.middle - other.middle)
        return all((np.maximum(gap - v.half, 0) ** 2).sum() >= 9 * u.half.max() ** 2 for u, v in ((self, other), (other, self)))


class _Own:
    """A block's points with the sums gathered so far. nest: (k, finest cluster, cluster) of all partitions.

    names, total and n are the finest clusters of the bucket at hand, the sums of distances to them and their points.
    """

    def __init__(self, slice_, ids, x: np.ndarray, y: np.ndarray, fine: np.ndarray, nest: dict[str, np.ndarray]):
        order = np.arange(len(x))
        self.box = _Box(x, y, fine, order, 0, len(x))
        self.slice, self.ids, self.x, self.y, self.fine, self.nest = slice_, ids.take(pa.array(order)), x[order], y[order], fine[order], nest
        self.ks = np.unique(nest["k"])
        self.near = {k: np.full(len(x), np.inf) for k in self.ks}
        self.inside = {k: (np.zeros(len(x)), np.zeros(len(x), np.int64)) for k in self.ks}
        self.bucket = None
        self._open()

    def _open(self) -> None:
        self.names, self.n, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((len(self.x), 0))

    def meet(self, bucket: int, x: np.ndarray, y: np.ndarray, fine: np.ndarray) -> None:
        """fine ascends; buckets follow each other."""
        if bucket != self.bucket:
            self._close()
            self.bucket = bucket
        starts = np.flatnonzero(np.diff(fine, prepend=fine[0] - 1))
        names = np.union1d(self.names, fine[starts])
        if len(names) > len(self.names):
            at, n, total = np.searchsorted(names, self.names), np.zeros(len(names), np.int64), np.zeros((len(self.x), len(names)))
            n[at], total[:, at] = self.n, self.total
            self.names, self.n, self.total = names, n, total
        self.n[np.searchsorted(names, fine[starts])] += np.diff(np.append(starts, len(fine)))
        order = np.arange(len(x))
        box = _Box(x, y, fine, order, 0, len(x))
        self._between(self.box, box, x[order], y[order], fine[order])

    def _between(self, own: _Box, other: _Box, x: np.ndarray, y: np.ndarray, fine: np.ndarray) -> None:
        """Adds the distances from the points of a box to those of another, by finest cluster."""
        many, rows = (own.hi - own.lo) * (other.hi - other.lo), slice(own.lo, own.hi)
        if many > 2 * NODES**4 and own.apart(other):
            names, sums = other.moments(x, y, fine)
            (u, v), (p, q) = own.nodes(), other.nodes()
            values = np.sqrt((u[:, None] - p) ** 2 + (v[:, None] - q) ** 2) @ sums.T
            self.total[rows, np.searchsorted(self.names, names)] += own.weights(self.x, self.y) @ values
        elif own.kids and (own.hi - own.lo >= other.hi - other.lo or not other.kids):
            for kid in own.kids:
                self._between(kid, other, x, y, fine)
        elif other.kids:
            for kid in other.kids:
                self._between(own, kid, x, y, fine)
        else:
            self._each(rows, x[other.lo : other.hi], y[other.lo : other.hi], fine[other.lo : other.hi])

    def _each(self, own: slice, x: np.ndarray, y: np.ndarray, fine: np.ndarray) -> None:
        starts = np.flatnonzero(np.diff(fine, prepend=fine[0] - 1))
        at, step = np.searchsorted(self.names, fine[starts]), max(1, PAIRS // len(x))
        d, e = np.empty((step, len(x))), np.empty((step, len(x)))
        for i in range(own.start, own.stop, step):
            rows = slice(i, min(i + step, own.stop))
            d, e = d[: rows.stop - i], e[: rows.stop - i]
            np.subtract(self.x[rows, None], x, out=d)
            np.subtract(self.y[rows, None], y, out=e)
            d *= d
            e *= e
            d += e
            self.total[rows, at] += np.add.reduceat(np.sqrt(d, out=d), starts, axis=1)

    def _close(self) -> None:
        """Passes the bucket's sums on; a cluster of any partition lies in one bucket."""
        for k in self.ks if len(self.names) else ():
            of = (self.nest["k"] == k) & np.isin(self.nest["fine"], self.names)
            fine, labels = np.searchsorted(self.names, self.nest["fine"][of]), self.nest["cluster"][of]
            order = np.lexsort((fine, labels))
            clusters, starts = np.unique(labels[order], return_index=True)
            total, n = np.add.reduceat(self.total[:, fine[order]], starts, axis=1), np.add.reduceat(self.n[fine[order]], starts)
            place = np.empty(len(self.names), np.int64)
            place[fine] = np.searchsorted(clusters, labels)
            here = np.minimum(np.searchsorted(self.names, self.fine), len(self.names) - 1)
            rows = np.flatnonzero(self.names[here] == self.fine)
            own = place[here[rows]]
            self.inside[k][0][rows], self.inside[k][1][rows] = total[rows, own], n[own]
            total /= n
            total[rows, own] = np.inf
            np.minimum(self.near[k], total.min(axis=1), out=self.near[k])
        self._open()

    def results(self) -> Iterator[pa.RecordBatch]:
        self._close()
        for k in self.ks:
            inside, n = self.inside[k]
            columns = [pa.array([self.slice] * len(n)), pa.array(np.full(len(n), k, np.int32)), self.ids, pa.array(inside), pa.array(inside / np.maximum(n - 1, 1), mask=n == 1), pa.array(self.near[k], mask=np.isinf(self.near[k]))]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "k", "id", "total", "a", "b"])

    def facts(self) -> Iterator[pa.RecordBatch]:
        """A row for each k and cluster of the block: points, those with others in their cluster, those with a silhouette and its sum, and the point of least total (ties: the least id)."""
        self._close()
        rank = pc.rank(self.ids).to_numpy()
        for k in self.ks:
            inside, n = self.inside[k]
            a, b = inside / np.maximum(n - 1, 1), self.near[k]
            one = np.isinf(b)
            wider = np.maximum(a, np.where(one, a, b))
            none = (n == 1) | (wider == 0)
            s = np.where(none | one, 0.0, (np.where(one, 0.0, b) - a) / np.where(none, 1.0, wider))
            of = self.nest["k"] == k
            fine = self.nest["fine"][of]
            order = np.argsort(fine)
            cluster = self.nest["cluster"][of][order][np.searchsorted(fine[order], self.fine)]
            names, at = np.unique(cluster, return_inverse=True)
            order = np.lexsort((rank, inside, at))
            first = order[np.searchsorted(at[order], np.arange(len(names)))]
            sums = [np.bincount(at, v, minlength=len(names)) for v in (np.ones(len(at)), n > 1, none | ~one, s)]
            columns = [pa.array([self.slice] * len(names)), pa.array(np.full(len(names), k, np.int32)), pa.array(names.astype(np.int32)), *map(pa.array, sums), pa.array(inside[first]), self.ids.take(pa.array(first))]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "k", "cluster_id", "n", "near", "told", "s", "total", "id"])


def _compare(batches: Iterator[pa.RecordBatch], results: Callable[[_Own], Iterator[pa.RecordBatch]] = _Own.results) -> Iterator[pa.RecordBatch]:
    """Rows of a group follow each other, the block's own points first."""
    own = group = None
    for batch in batches:
        for i in range(batch.num_rows):
            key = (batch.column("slice")[i].as_py(), batch.column("own")[i].as_py())
            x, y, fine = (batch.column(c)[i].values.to_numpy() for c in ("x", "y", "fine"))
            if batch.column("part")[i].as_py() == 0:
                if own is not None:
                    yield from results(own)
                nest = batch.column("nest")[i].values
                own, group = _Own(key[0], batch.column("ids")[i].values, x, y, fine, {c: nest.field(c).to_numpy() for c in ("k", "fine", "cluster")}), key
            elif key == group:
                own.meet(batch.column("bucket")[i].as_py(), x, y, fine)
    if own is not None:
        yield from results(own)


def cluster_distances(points: DataFrame, assigned: DataFrame, block: int = BLOCK, nested: bool = True, few: int = FEW) -> DataFrame:
    """(slice, k, id, total, a, b): the sum and mean of a point's distances to the others of its cluster, and the least mean to another cluster.

    points: (slice, id, x, y); assigned: (slice, k, id, cluster_id), where every k has all points of the slice. The partitions of a
    slice are nested; else the finest clusters are those that all of them tell apart. a is null for a lone
    point, b where there is one cluster.
    """
    each = F.struct(F.col("k").cast("long").alias("k"), F.col("cluster_id").cast("long").alias("cluster"))
    if nested:
        most = assigned.groupBy("slice").agg(F.max("k").alias("k"))
        fine = cut(assigned.join(most, ["slice", "k"]).select("slice", "id", F.col("cluster_id").cast("long").alias("fine")), "finest")
        nest = assigned.join(fine, ["slice", "id"]).select("slice", "fine", each.alias("n")).distinct()
    else:
        cells = cut(assigned.groupBy("slice", "id").agg(F.sort_array(F.collect_list(each)).alias("cell")), "cells")
        fine, nest = _finest(cells, F.explode("cell"))
    kind = points.schema["id"].dataType.simpleString()
    return _met(points, fine, nest, block, few).mapInArrow(_compare, f"slice string, k int, id {kind}, total double, a double, b double")


def _finest(cells: DataFrame, each: Column) -> tuple[DataFrame, DataFrame]:
    """((slice, id, fine), (slice, fine, n)) of the points' cells (slice, id, cell, ...); each: rows (k, cluster) of a cell."""
    # a row for each finest cluster
    numbers = cut(cells.drop("id").distinct().withColumn("fine", F.row_number().over(W.partitionBy("slice").orderBy("cell")).cast("long")), "cell-numbers")
    return cut(cells.join(numbers.select("slice", "cell", "fine"), ["slice", "cell"]).select("slice", "id", "fine"), "finest"), numbers.select("slice", "fine", each.alias("n"))


def cluster_facts(points: DataFrame, cells: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(slice, k, cluster_id, n, near, told, s, total, id): what the points of a block add to each cluster of each partition, see _Own.facts.

    points: (slice, id, x, y); cells: (slice, id, ks, cell), a point's clusters in the partitions ks of its slice.
    """
    each = F.explode(F.zip_with("ks", "cell", lambda k, c: F.struct(k.cast("long").alias("k"), c.cast("long").alias("cluster"))))
    kind = points.schema["id"].dataType.simpleString()
    run = partial(_compare, results=_Own.facts)
    return _met(points, *_finest(cells, each), block, few).mapInArrow(run, f"slice string, k int, cluster_id int, n double, near double, told double, s double, total double, id {kind}")


def _along(c: str) -> Column:
    """In which of SIDE cells between the least and the greatest x (or y) of its slice a point lies, with room for the other's bits between the bits."""
    low, high = F.col(f"low{c}"), F.col(f"high{c}")
    cell = F.floor((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)) * SIDE)
    cell = F.least(F.coalesce(cell, F.lit(0)), F.lit(SIDE - 1)).cast("int")
    bits = range(SIDE.bit_length() - 1)
    return reduce(Column.bitwiseOR, [F.shiftleft(cell.bitwiseAND(F.lit(1 << i)), i) for i in bits])


def _met(points: DataFrame, fine: DataFrame, nest: DataFrame, block: int, few: int) -> DataFrame:
    """Every block of a slice followed by all blocks of the slice, as _compare takes them."""
    nest = nest.groupBy("slice").agg(F.collect_list(F.struct("n.k", "fine", "n.cluster")).alias("nest"))
    sizes = cut(nest.select("slice", "nest", F.size(F.array_distinct("nest.fine")).alias("clusters"), F.size(F.array_distinct("nest.k")).alias("ks")), "nests")
    p = points.select("slice", "id", "x", "y").join(fine, ["slice", "id"])
    one, many = F.col("ks") == 1, F.col("clusters") > few
    size = F.when(~many, block).when(one, F.ceil(F.lit(block) / 4)).otherwise(F.ceil(F.lit(block) * few / F.col("clusters")))
    facts = sizes.select("slice", size.alias("size"), (one & many).alias("apart"))
    deal = p.groupBy("slice").agg(F.count("*").alias("n")).join(facts, "slice").select("slice", "size", "apart", F.ceil(F.col("n") / F.col("size")).alias("deal"))
    dealt = p.join(deal, "slice").withColumn("bucket", F.when(F.col("apart"), F.pmod(F.xxhash64("fine"), F.col("deal"))).otherwise(0).cast("int"))
    # blocks follow each other along a curve through SIDE x SIDE cells of the slice's box; a crowded cell is several blocks
    box = points.groupBy("slice").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    put = dealt.join(box, "slice").withColumn("z", _along("x").bitwiseOR(F.shiftleft(_along("y"), 1))).select("slice", "bucket", "size", "fine", "id", "x", "y", "z")
    counts = put.groupBy("slice", "bucket", "z").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("slice", "bucket").orderBy("z").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    curve = cut(counts.select("slice", "bucket", "z", F.floor(before / F.col("size")).alias("block"), F.ceil(F.col("n") / F.col("size")).alias("parts")), "curve")
    blocked = put.join(curve, ["slice", "bucket", "z"]).groupBy("slice", "bucket", "block", F.pmod(F.xxhash64("id"), F.col("parts")).alias("share"))
    blocks = cut(blocked.agg(F.sort_array(F.collect_list(F.struct("fine", "id", "x", "y"))).alias("points")), "blocks")
    field = lambda c: F.transform("points", lambda q: q[c]).alias(c)
    fields = [field(c) for c in ("x", "y", "fine")]
    ids = F.transform("points", lambda q: q["id"])
    name = F.struct("bucket", "block", "share")
    own = blocks.join(sizes, "slice").select("slice", name.alias("own"), F.lit(0).alias("part"), "bucket", *fields, ids.alias("ids"), "nest")
    kinds = own.schema
    targets = blocks.select("slice", name.alias("own"))
    others = blocks.join(targets, "slice").select("slice", "own", F.lit(1).alias("part"), "bucket", *fields, F.lit(None).cast(kinds["ids"].dataType).alias("ids"), F.lit(None).cast(kinds["nest"].dataType).alias("nest"))
    # few rows that hold much: dealt out by number, so that small tables use all cores too
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.unionByName(others).repartition(n, "slice", "own").sortWithinPartitions("slice", "own", "part", "bucket")
