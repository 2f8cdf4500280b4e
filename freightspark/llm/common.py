"""Helpers that several operators share: table access, folds, word and shingle hashes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that the vectorised hashes work on at once.
BLOCK_BYTES = 1 << 20


#: Rows of a batch that Spark hands to Python, where the session has its default of 10 000: texts make rows long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]
#: What a worker keeps between tasks: one object, that of the operator at work.
_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, build: Callable[[], Any]) -> Any:
    """The object that `build` makes, once in a worker as long as no other operator works there."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


@functools.cache
def _few_arenas() -> None:
    """glibc gives each thread an arena that hardly shrinks; two do for a worker. -8 is M_ARENA_MAX."""
    if tune := getattr(ctypes.CDLL(None), "mallopt", None):
        tune(-8, 2)


def enter(key: Hashable) -> None:
    """What other operators keep in this worker goes."""
    _few_arenas()
    if key not in _kept:
        _kept.clear()


def leave() -> None:
    """Hands freed memory back to the system: workers are used again, and an executor's memory counts them all."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Batches], Batches], key: Hashable = None) -> Callable[[Batches], Batches]:
    """The function of a mapInArrow, in a worker that keeps nothing of other operators and no freed memory afterwards."""

    @functools.wraps(run)
    def inner(batches: Batches) -> Batches:
        enter(key)
        try:
            yield from run(batches)
        finally:
            leave()

    return inner


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the fold of a document. A null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores after it while a column has that name (Spark doesn't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one hold about `limit` bytes; a longer single text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = U64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0 to n at least; those for a usual block are kept, those for a longer text are not."""
    if _powers and len(_powers[0]) > n:
        return _powers
    size = 1 << (n + 1).bit_length()
    made = [np.concatenate(([U64(1)], np.cumprod(np.full(size, x, U64)))) for x in (_BASE, _BASE_INVERSE)]
    if size <= 2 * BLOCK_BYTES:
        _powers[:] = made
    return made


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs values[start:end], equal for equal runs wherever they stand: prefix sums of a polynomial."""
    up, down = _power_tables(len(values))
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(values * down[: len(values)])))
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(U64) * _LENGTH)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for byte spans that ascend and don't overlap, a block at a time, so that a long text takes no arrays of its length."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    out = np.zeros(len(starts), U64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_BYTES // 4, side="right")))
        n = sizes[at:upto]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        values = (data[np.repeat(starts[at:upto], n) + inside].astype(U64) + U64(1)) * _power_tables(int(n.max()))[1][inside]
        full = n > 0
        if full.any():
            out[at:upto][full] = np.add.reduceat(values, first[full])
        at = upto
    return mix(out + sizes.astype(U64) * _LENGTH)


#: A-Z to a-z; ASCII punctuation and control characters to a space. Other bytes (letters beyond ASCII) stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the case-folded words of all texts, one after another, and the number of words of each text.

    A word is a maximal run of bytes that are neither ASCII punctuation nor white space nor control characters.
    """
    encoded = [t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    inside = np.concatenate(([False], data != 32, [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    limits = np.cumsum([len(e) + 1 for e in encoded])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, limits))))
    return span_hashes(data, starts, ends), counts


_STEP = 0xC2B2AE3D27D4EB4F


def shingle_hashes(texts: list[str], width: int, lead: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text, in order, and the number of runs of each text.

    A text of fewer words has one run, all its words; a text without words has none. With `lead` the
    shorter runs at the start of a text (its first word, its first two words, ...) count as well.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) + (width - 1) * (doc + 1)
    padded = np.zeros(len(words) + (width - 1) * (len(texts) + 1), U64)
    padded[place] = words
    runs, factor = np.zeros(len(words), U64), 1
    for k in range(width):
        runs += padded[place - k] * U64(factor)
        factor = factor * _STEP % (1 << 64)
    runs = mix(runs)
    if lead:
        return runs, counts
    rank = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = rank >= np.minimum(width, np.repeat(counts, counts)) - 1
    return runs[keep], np.bincount(doc[keep], minlength=len(texts))
