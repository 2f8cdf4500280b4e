"""Line dedup: content-defined chunks of lines; chunks that stand elsewhere as well are removed, but for the first.

Units are lines. A line of more than LONG_WORDS words is cut further, after sentence ends and after words whose hash
is divisible by WORD_IN, so that a passage within it has the same units whatever stands around it. A rolling hash over
the hashes of two units chooses chunk boundaries: a passage has the same inner chunks wherever it is inserted. A chunk
has MIN_UNITS to MAX_UNITS units and at least MIN_WORDS words. Chunks are counted by hash over the whole corpus; those
that repeat are read again from the texts and compared as bytes, and all but the first (least doc_id, then place) go.

A passage's ends lie in chunks that reach beyond it, so in fewer than MAX_UNITS units on either side of its whole
chunks. These units are compared with those around the first one, as bytes too, and go as far as they are equal.

Defined cases: a null text is an empty text and stays null; a text that has nothing but repeated chunks becomes
empty; wholly equal rows (doc_id and text) count as one document and are cleaned alike; a null doc_id comes
first; very long texts are read whole; empty tables give empty results. All columns are kept, whatever their names;
n_chars, where it exists, is counted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightspark.functions.shared import cut, discard
from freightspark.llm.common import U64, blocks, lean, mix, run_hashes, span_hashes, unused

LONG_WORDS, WORD_IN = 24, 4
MIN_UNITS, MAX_UNITS, MIN_WORDS, ONE_IN = 2, 12, 10, 2
#: Bytes of lists that may be broadcast, and beyond that the ids of the documents that have lists: only these are then
#: shuffled to their lists. Beyond both bounds all documents are.
LIST_BYTES, KEY_BOUND = 96 << 20, 4_000_000
BLOCK = 1 << 19
NULL_ID = -(1 << 63)


def _divided(line: np.ndarray, n_lines: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each unit, and which lines are long. line: of each word; after: whether a long line is cut after the word."""
    sizes = np.bincount(line, minlength=n_lines)
    long = sizes > LONG_WORDS
    start = np.ones(len(line), bool)
    start[1:] = (line[1:] != line[:-1]) | (after[:-1] & long[line[1:]])
    return np.flatnonzero(start), long


class Units:
    """Units of a batch of texts, and their chunks."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        base = np.cumsum(sizes) - sizes
        space = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13))))
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edge[::2], edge[1::2]
        words = span_hashes(data, starts, ends)
        breaks = np.flatnonzero(data == 10)
        ended = np.isin(data[ends - 1], (33, 46, 63))
        first, _ = _divided(np.searchsorted(breaks, starts), len(breaks), ended | (words % U64(WORD_IN) == 0))
        last = np.append(first, len(starts))[1:]
        self.words = last - first
        self.hashes = run_hashes(words, first, last)
        doc = np.searchsorted(base, starts[first], side="right") - 1
        self.count = np.bincount(doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        self.starts, self.ends = starts[first] - base[doc], ends[last - 1] - base[doc]
        rolling = mix(self.hashes * U64(0x9E3779B97F4A7C15) + np.concatenate((np.zeros(1, U64), self.hashes))[: len(self.hashes)])
        self.candidate = rolling % U64(ONE_IN) == 0

    def chunks(self, i: int) -> list[tuple[int, int]]:
        """(first unit, unit after the last) of each chunk of text i, counted within the text; a short rest is none."""
        a = int(self.first[i])
        b = a + int(self.count[i])
        out, start, words = [], 0, 0
        for k, (w, c) in enumerate(zip(self.words[a:b].tolist(), self.candidate[a:b].tolist(), strict=True), 1):
            words += w
            if k - start >= MIN_UNITS and words >= MIN_WORDS and (c or k - start >= MAX_UNITS):
                out.append((start, k))
                start, words = k, 0
        if b - a - start >= MIN_UNITS and words >= MIN_WORDS:
            out.append((start, b - a))
        return out

    def bytes_of(self, i: int, u: int, v: int) -> bytes:
        """Units u to v of text i."""
        a = int(self.first[i])
        return self.texts[i][int(self.starts[a + u]) : int(self.ends[a + v - 1])]

    def before(self, i: int, u: int) -> list[bytes]:
        """The units before unit u, nearest first."""
        return [self.bytes_of(i, k, k + 1) for k in range(u - 1, max(-1, u - MAX_UNITS), -1)]

    def after(self, i: int, v: int) -> list[bytes]:
        return [self.bytes_of(i, k, k + 1) for k in range(v, min(int(self.count[i]), v + MAX_UNITS - 1))]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("id"), _tag().alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def _tag() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _binary(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, limit=BLOCK):
        units = Units(_binary(batch))
        own = [units.chunks(i) for i in range(batch.num_rows)]
        doc = np.repeat(np.arange(batch.num_rows), [len(c) for c in own])
        if not len(doc):
            continue
        u, v = np.array([x for c in own for x in c], np.int64).T
        h = run_hashes(units.hashes, units.first[doc] + u, units.first[doc] + v)
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("id").take(take), batch.column("tag").take(take), pa.array(u.astype(np.int32))], names=["h", "id", "tag", "at"])


_INSTANCE = "id long, tag long, at int, upto int, chunk binary, before array<binary>, after array<binary>"


def _instance_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed chunks of each text: their bytes, and the units around a run of listed chunks, as its last ones hold."""
    for batch in blocks(batches, limit=BLOCK):
        units, rows = Units(_binary(batch)), []
        for i, (doc_id, tag, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "places")), strict=True)):
            end = dict(units.chunks(i))
            listed = set(places)
            ends = {end[u] for u in listed}
            for u in places:
                v = end[u]
                rows.append((doc_id, tag, u, v, units.bytes_of(i, u, v), [] if u in ends else units.before(i, u), [] if v in listed else units.after(i, v)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _INSTANCE.split(", ")])


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units around the listed chunks of each text, whatever stands there."""
    for batch in blocks(batches, limit=BLOCK):
        units, rows = Units(_binary(batch)), []
        for i, (doc_id, tag, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "places")), strict=True)):
            end = dict(units.chunks(i))
            rows += [(doc_id, tag, u, units.before(i, u), units.after(i, end[u])) for u in places]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "tag", "at", "before", "after"])


def _with_lists(docs: DataFrame, lists: DataFrame, key: list[str], column: str, how: str) -> DataFrame:
    """docs joined with their lists (id, tag, array). A list takes less than 96 bytes and 40 an element."""
    size = lists.agg(F.coalesce(F.sum(F.lit(96) + 40 * F.size(column)), F.lit(0))).first()[0]
    if size <= LIST_BYTES:
        return docs.join(F.broadcast(lists), key, how)
    ids = lists.select(key[0]).distinct()
    if ids.count() > KEY_BOUND:
        return docs.join(lists, key, how)
    ids = F.broadcast(ids)
    touched = docs.join(ids, key[0], "left_semi").join(lists, key, how)
    if how == "inner":
        return touched
    rest = docs.join(ids, key[0], "left_anti").withColumn(column, F.lit(None).cast(lists.schema[column].dataType))
    return touched.unionByName(rest)


def _places(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("id", "tag").agg(F.sort_array(F.collect_set("at")).alias("places")), "chunk-places")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(id, tag, at, upto): unit ranges to remove; id and tag name the document (see _keyed)."""
    keyed = _keyed(docs)
    chunks = cut(keyed.mapInArrow(lean(_chunk_rows), "h long, id long, tag long, at int"), "chunks")
    # written, so that both sides of the join are plain shuffles and a very common chunk's rows can be split
    often = cut(chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "chunk-hashes")
    lists = _places(chunks.join(often, "h"))
    for done in (chunks, often):
        discard(done)
    found = cut(_with_lists(keyed, lists, ["id", "tag"], "places", "inner").mapInArrow(lean(_instance_rows), _INSTANCE), "chunk-bytes")
    # equal bytes, not only equal hashes: the first of each chunk, then all others beside it
    key, here = F.xxhash64("chunk"), F.struct("id", "tag", "at")
    first = found.groupBy(key.alias("k"), "chunk").agg(F.count("*").alias("n"), F.min(here).alias("one")).where("n > 1").select("k", "chunk", "one")
    first = cut(first, "chunk-firsts")
    others = found.withColumn("k", key).join(first, ["k", "chunk"]).where("struct(id, tag, at) > one").drop("k", "chunk")
    others = cut(others, "chunk-others", replaces=found)
    discard(first)
    # what stands around the firsts is read only where it is compared
    outer = others.where("size(before) + size(after) > 0")
    asked = _places(outer.select("one.*").distinct())
    edges = _with_lists(keyed, asked, ["id", "tag"], "places", "inner").mapInArrow(lean(_edge_rows), "id long, tag long, at int, before array<binary>, after array<binary>")
    edges = cut(edges.select(here.alias("one"), F.col("before").alias("first_before"), F.col("after").alias("first_after")), "chunk-edges")

    def alike(a: str) -> Column:
        """How many units, from the chunk outwards, equal those around the first."""
        same = F.zip_with(a, f"first_{a}", lambda x, y: F.coalesce(x == y, F.lit(False)))
        wrong = F.array_position(same, F.lit(False)).cast("int")
        return F.when(wrong > 0, wrong - 1).otherwise(F.size(same))

    wide = outer.join(edges, "one").select("id", "tag", (F.col("at") - alike("before")).alias("at"), (F.col("upto") + alike("after")).alias("upto"))
    return others.where("size(before) + size(after) = 0").select("id", "tag", "at", "upto").union(wide)


def remove_repeats(docs: DataFrame, spans: bool = False) -> DataFrame:
    """The documents without their repeated chunks. With `spans` also `removed` (with underscores after it where docs
    has that column): an array of the removed (start, end) in code points.
    """
    ranges = repeated_chunks(docs).distinct().groupBy("id", "tag").agg(F.collect_list(F.struct("at", "upto")).alias("ranges"))
    names = docs.columns
    own_id, own_tag, own_ranges, removed = (unused(n, names) for n in ("id", "tag", "ranges", "removed"))
    ranges = cut(ranges.select(F.col("id").alias(own_id), F.col("tag").alias(own_tag), F.col("ranges").alias(own_ranges)), "chunk-ranges")
    joined = _with_lists(docs.withColumns({own_id: _id(), own_tag: _tag()}), ranges, [own_id, own_tag], own_ranges, "left").select(*names, own_ranges)
    schema = docs.schema if not spans else docs.select("*", F.expr("cast(null as array<struct<start: int, end: int>>)").alias(removed)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            texts, gone = batch.column("text").to_pylist(), [[] for _ in range(batch.num_rows)]
            lists = batch.column(own_ranges).to_pylist()
            touched = [i for i, r in enumerate(lists) if r]
            units = Units([texts[i].encode("utf-8", "surrogatepass") for i in touched]) if touched else None
            for j, i in enumerate(touched):
                a, data, kept, at, done = int(units.first[j]), units.texts[j], [], 0, 0
                for r in sorted((r["at"], r["upto"]) for r in lists[i]):
                    s = int(units.starts[a + r[0]])
                    # what follows up to the next unit goes with the range
                    e = int(units.starts[a + r[1]]) if r[1] < units.count[j] else len(data)
                    if e <= at:
                        continue
                    s = max(s, at)
                    kept.append(data[at:s])
                    start = done + len(data[at:s].decode("utf-8", "surrogatepass"))
                    done = start + len(data[s:e].decode("utf-8", "surrogatepass"))
                    if gone[i] and gone[i][-1]["end"] == start:
                        gone[i][-1]["end"] = done
                    else:
                        gone[i].append({"start": start, "end": done})
                    at = e
                texts[i] = b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
            out = {n: batch.column(n) for n in names}
            out["text"] = pa.array(texts, out["text"].type)
            if "n_chars" in out and touched:
                out["n_chars"] = pa.array([len(texts[i]) if lists[i] else n for i, n in enumerate(out["n_chars"].to_pylist())], out["n_chars"].type)
            if spans:
                out[removed] = pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return joined.mapInArrow(lean(run), schema)
