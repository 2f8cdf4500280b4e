"""Centroid clustering over bit planes: exact squared distances from weighted AND-popcounts.

A vector of 64 integer components is kept as its bit planes in two's complement, one 64-bit word a plane: word i has bit
i of every component. Plane i weighs 2**i, the last one -2**i, so the dot product of two vectors is the weighted sum of
popcounts of ANDed planes, and all distances are exact integers. A round reads the planes once; a task adds up its own
vectors by cluster, and only the totals (k * 64 numbers) reach the driver.

Defined cases: vectors that are null, have another number of components than 64, or hold a null or non-finite one are
left out; components beyond +-LIMIT count as +-LIMIT; a null id is hashed as empty text; rows of equal hash are ordered
by their planes; repeated rows count as often as they occur; with fewer vectors than centroids every vector starts one;
an empty table gives an empty result; sums of distances beyond a long are null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.functions.shared import cut
from freightspark.llm.common import U64, lean

WIDTH, SCALE = 64, 64
#: Components are cut off here, so that a squared distance is below 2**62.
LIMIT = (1 << 27) - 1
CENTROIDS, ROUNDS, SEED = 16, 3, 1
#: Vectors that are compared with the centroids at once.
BLOCK = 8192


def n_planes(low: int, high: int) -> int:
    """Planes in two's complement that hold all integers from low to high."""
    return max((max(high, -low - 1, 0)).bit_length() + 1, 2)


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """(vectors, planes) words of (vectors, 64) integers."""
    bits = (x[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def unpack(words: np.ndarray) -> np.ndarray:
    """The (vectors, 64) integers of their planes."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")
    return np.einsum("npc,p->nc", bits.astype(np.int64), plane_weights(words.shape[1]))


def plane_weights(planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] *= -1
    return w


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of each row of planes in a with each in b (or with its own row where b is a)."""
    wa, wb = plane_weights(a.shape[1]), plane_weights(b.shape[1])
    if a is b:
        return sum(wa[i] * wb[j] * np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64) for i in range(len(wa)) for j in range(len(wb)))
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(len(wa)):
        for j in range(len(wb)):
            out += wa[i] * wb[j] * np.bitwise_count(a[:, i, None] & b[None, :, j])
    return out


def nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number."""
    c = pack(centroids, n_planes(int(centroids.min()), int(centroids.max())))
    cluster, distance = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    own = dots(c, c)
    for at in range(0, len(words), BLOCK):
        w = np.ascontiguousarray(words[at : at + BLOCK])
        d = dots(w, w)[:, None] - 2 * dots(w, c) + own[None, :]
        cluster[at : at + BLOCK] = best = d.argmin(axis=1)
        distance[at : at + BLOCK] = d[np.arange(len(w)), best]
    return cluster, distance


def _words(column: pa.ListArray) -> np.ndarray:
    """Planes of a batch; rows with fewer planes repeat their last, which holds the sign."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().view(U64)
    first = np.cumsum(lengths) - lengths
    at = np.minimum(np.arange(lengths.max(initial=1))[None, :], lengths[:, None] - 1)
    return flat[first[:, None] + at]


def planes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, planes array<long>) of the vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            x = np.clip(np.floor(SCALE * v), -LIMIT, LIMIT).astype(np.int64)
            words = pack(x, n_planes(int(x.min()), int(x.max())))
            # each row has as many planes as its own components take, whatever batch it is in
            need = np.array([n_planes(a, b) for a, b in zip(x.min(axis=1).tolist(), x.max(axis=1).tolist(), strict=True)])
            ends = np.append(0, np.cumsum(need)).astype(np.int32)
            own = words[np.arange(words.shape[1])[None, :] < need[:, None]].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(own))], names=["id", "planes"])

    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where((F.size("v") == WIDTH) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return v.mapInArrow(lean(run), "id long, planes array<long>")


def first_centroids(packed: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors of least hash: (at most k, 64) integers."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = packed.select(order.alias("h"), "planes").orderBy("h", "planes").limit(k).toArrow()
    return unpack(_words(rows.column("planes").combine_chunks())) if rows.num_rows else np.zeros((0, WIDTH), np.int64)


def totals(packed: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(vectors of each cluster, their sums by component, their sums of distances) under the given centroids."""
    known = packed.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by cluster: sums of the components, the number, and the distances in two halves, so that nothing overflows
        out = np.zeros((len(known.value), WIDTH + 3), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words(batch.column("planes"))
            cluster, distance = nearest(words, known.value)
            np.add.at(out, cluster, np.column_stack([unpack(words), np.ones(len(words), np.int64), distance & 0xFFFFFFFF, distance >> 32]))
        k, what = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(what), pa.array(out[k, what])], names=["cluster", "what", "total"])

    sums = packed.select("planes").mapInArrow(lean(run), "cluster long, what long, total long").groupBy("cluster", "what").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros((len(centroids), WIDTH + 3), np.int64)
    out[sums.column("cluster").to_numpy(), sums.column("what").to_numpy()] = sums.column("total").to_numpy()
    return out[:, WIDTH], out[:, :WIDTH], [int(high) * (1 << 32) + int(low) for low, high in out[:, WIDTH + 1 :]]


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    packed = cut(planes(vectors, id_col, vec_col), "planes")
    centroids = first_centroids(packed, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        n, sums, _ = totals(packed, centroids)
        full = n > 0
        centroids[full] = sums[full] // n[full, None]
    inertias = totals(packed, centroids)[2] if len(centroids) else []
    fits = lambda x: x if x < 1 << 63 else None
    known = packed.sparkSession.sparkContext.broadcast((centroids, [fits(x) for x in inertias], fits(sum(inertias)), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, own, whole, digests = known.value
        own, digests = pa.array(own, pa.int64()), pa.array(digests)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance = nearest(_words(batch.column("planes")), centroids)
            at = pa.array(cluster.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), at, pa.array(distance), own.take(at), pa.array([whole] * len(cluster), pa.int64()), digests.take(at)], names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return packed.mapInArrow(lean(run), f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
