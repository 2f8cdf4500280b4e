"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least of the 64-bit hashes of a text's distinct shingles (five folded words; the shorter
runs at its start count too, so that a text of a few words has shingles). Sketches of the parts of a text merge
into that of the whole; two of them estimate resemblance, containment and distinct shingle counts. As text, a
fingerprint is the ascending hashes in hexadecimal, 16 digits each.

Defined cases: a null text is an empty text; a text without words has the empty fingerprint, which resembles
only itself (1.0) and is contained in everything; equal texts have equal fingerprints; rows with equal doc_id
are ordered by their text; a null doc_id comes last; very long texts are read whole; an empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.llm.common import U64, blocks, lean, shingle_hashes

WIDTH, K = 5, 64
#: Bytes of text in a range of ids, which is a task, where that makes more ranges than spark.sql.shuffle.partitions;
#: texts count in units of so many bytes.
RANGE_BYTES, UNIT_BYTES = 64 << 20, 4096
NULL_ID = -(1 << 63)


def sketches(texts: list[str], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """Ascending array of at most k hashes for each text."""
    runs, counts = shingle_hashes(texts, width, lead=True)
    ends = np.cumsum(counts)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        own = runs[a:b]
        m = 2 * k
        while len(own) > m:  # the k least distinct ones are among the m least, unless those repeat
            least = np.unique(np.partition(own, m - 1)[:m])
            if len(least) >= k:
                own = least
                break
            m *= 2
        out.append(np.unique(own)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A or B|; exact where the union has at most k shingles."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A|."""
    own = distinct_count(a, k)
    return 1.0 if not own else min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / own)


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(U64)


def fingerprint(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, distinct_shingles) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            own = sketches([t or "" for t in batch.column("text").to_pylist()], k, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([to_text(s) for s in own]), pa.array([distinct_count(s, k) for s in own])], names=["doc_id", "fingerprint", "distinct_shingles"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, fingerprint string, distinct_shingles double")


def merge_fingerprints(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Merge fingerprints of parts that share the columns `by`: the k least distinct hashes, cut to k before the shuffle as well."""
    from pyspark.sql.window import Window as W

    hashes = parts.select(*by, F.explode(F.regexp_extract_all("fingerprint", F.lit("[0-9a-f]{16}"), F.lit(0))).alias("h"), F.spark_partition_id().alias("p"))
    for deal in ([*by, "p"], by):
        hashes = hashes.dropDuplicates([*deal, "h"]).withColumn("r", F.row_number().over(W.partitionBy(*deal).orderBy("h"))).where(F.col("r") <= k).drop("r")
    return hashes.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("fingerprint"))


def _bounds(docs: DataFrame, range_bytes: int) -> list[int]:
    """Descending ids that start the ranges; each is an id of the table. 8 bytes on the driver for each range_bytes of text."""
    units = (F.coalesce(F.octet_length("text"), F.lit(0)) / UNIT_BYTES).cast("int") + 1
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), units.alias("n"))
    n, top = ids.agg(F.sum("n"), F.max("id")).first()
    if n is None:
        return []
    m = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * UNIT_BYTES // range_bytes))
    probs = [j / m for j in range(1, m)]
    weighed = ids.select(F.explode(F.array_repeat("id", F.col("n"))).alias("id"))
    cuts = weighed.agg(F.percentile_approx("id", probs, 10 * m + 1000)).first()[0] if probs else []
    return sorted({top, *cuts}, reverse=True)


def _deal(starts: list[int]):
    """Each row to its range; a row that starts a range goes to the range before as well, as what follows that one's last row."""
    ascending = np.array(starts[::-1], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(ascending)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID)
            v = ids.to_numpy(zero_copy_only=False)
            place = m - 1 - np.searchsorted(ascending, v, side="left")
            head = np.flatnonzero(ascending[m - 1 - place] == v)
            take = np.concatenate((np.arange(len(v)), head))
            ranges = np.concatenate((place, (place[head] - 1) % m)).astype(np.int32)
            after = np.concatenate((np.zeros(len(v), bool), np.ones(len(head), bool)))
            t = pa.array(take)
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(after), ids.take(t), batch.column("text").fill_null("").take(t)], names=["r", "after", "id", "text"])

    return run


def with_edits(docs: DataFrame, k: int = K, width: int = WIDTH, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next one (descending doc_id; the first follows the last).

    The edited text's last floor(n / 2) code points are the first as many of the next text. Texts cross the
    network once: rows are dealt by range of ids and sorted there, and the row that follows a range's last one
    is dealt to that range as well. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited_contained, distinct_shingles.
    """
    starts = _bounds(docs, range_bytes)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_contained", "distinct_shingles"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def made(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        """rows: (range, after, id, text); following: the row after the last."""
        texts = [x[3] for x in rows] + [following[3]]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
        own, new = sketches(texts, k, width), sketches(edited, k, width)
        out = []
        for i, (_, _, doc_id, text) in enumerate(rows):
            digest = hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest()
            out.append((None if doc_id == NULL_ID else doc_id, len(text), digest, to_text(own[i]), to_text(new[i]), resemblance(own[i], new[i], k), resemblance(own[i], own[i + 1], k), containment(new[i], own[i], k), distinct_count(own[i], k)))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in blocks(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("r", "after", "id", "text")), strict=True):
                if held and (row[1] or size > 1 << 20):
                    yield made(held, row)
                    held, size = [], 0
                if not row[1]:
                    held.append(row)
                    size += len(row[3])
        assert not held, "a range without a following row"

    if not starts:
        starts = [0]
    dealt = docs.select("doc_id", "text").mapInArrow(lean(_deal(starts)), "r int, after boolean, id long, text string")
    # a range is a partition: none has two while another has none
    sorted_ = dealt.repartitionById(max(1, len(starts)), F.col("r")).sortWithinPartitions("r", "after", F.col("id").desc(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_contained double, distinct_shingles double"
    return sorted_.mapInArrow(lean(run), schema)
