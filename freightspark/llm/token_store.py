"""Token-id output: concatenated ids with Elias-Fano encoded document boundaries.

File format (a Parquet file set that Spark writes and commits, so a lost executor leaves no partial file):
one row per segment, in ascending (shard, segment) order, holding whole documents in ascending doc_id order.

  shard, segment  place in the order
  base            ids of the shard before this segment
  n_null, first   documents without a doc_id, which come first; the least doc_id of the others
  doc_ids         EliasFano.to_bytes(): the other doc_ids, less the first
  ids             all ids of the segment, little-endian unsigned, `width` bytes each (2 or 4)
  bounds          EliasFano.to_bytes(): where each document ends within `ids`

A document's place in the whole output is the ids of all earlier shards (one sum per shard), plus base, plus
the boundary before it, which the reader gets by select. Boundaries take about 2 + log2(ids per document) bits each and
half a bit for the samples of select, instead of 64.

Defined cases: a null text is an empty text, which still has its end id; rows with equal doc_id are ordered by
their text; very long texts are segments of their own; an empty table writes no segment; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.shared import cut
from freightspark.llm.common import blocks, kept, lean

END_ID = 1
#: Ids and documents of a segment at most, but a longer document stands alone.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 14
#: Distinct words whose ids a worker keeps (about 200 bytes each).
CACHE_WORDS = 1_000_000
#: Bytes of text in a shard, where that makes more shards than spark.sql.shuffle.partitions.
SHARD_BYTES = 128 << 20
#: Texts that tell whether a tokenizer's pieces keep within words.
PROBES = ("Hello World again", " leading and  double spaces ", "line\nbreak\ttab", "Don't stop, it's 42.5% (ok)!", "ÀÉ naïve Straße", "x  \n\n y", "a.b,c d_e f-g", "UPPER lower MiXeD", "12 345 6")


#: Ones of each byte, and the place of its k-th one.
_ONES = np.array([x.bit_count() for x in range(256)])
_PLACE = np.array([([k for k in range(8) if x >> k & 1] + [0] * 8)[:8] for x in range(256)])


class EliasFano:
    """A non-decreasing sequence of integers below 2**63: low bits packed, high bits in unary, sampled select."""

    STEP = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        """samples: place of each STEP-th one of the unary part."""
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        if low_bits:
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        unary = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[:: cls.STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8")
        return head.tobytes() + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = (int(x) for x in np.frombuffer(data, "<u8", 4))
        n_samples = -(-n // cls.STEP)
        raw = np.frombuffer(data, np.uint8, a + b, 32 + 4 * n_samples)
        return cls(n, low_bits, raw[:a], raw[a:], np.frombuffer(data, "<u4", n_samples, 32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out

    def select(self, i: int) -> int:
        """Place of the i-th one of the unary part: from the sample before it, byte by byte."""
        at = int(self.samples[i // self.STEP])
        left, byte = i % self.STEP, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def selects(self, i: np.ndarray) -> np.ndarray:
        """select of many at once: from the sample before each, a byte further in every step for those that are not there yet."""
        at = self.samples[i // self.STEP].astype(np.int64)
        left, byte = i % self.STEP, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        todo = np.flatnonzero(_ONES[word] <= left)
        while len(todo):
            left[todo] -= _ONES[word[todo]]
            byte[todo] += 1
            word[todo] = self.high[byte[todo]]
            todo = todo[_ONES[word[todo]] <= left[todo]]
        return byte * 8 + _PLACE[word, left]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th integers."""
        return (self.selects(i) - i) << self.low_bits | self._low(i)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self.select(i) - i) << self.low_bits | int(self._low(np.array([i], np.int64))[0])

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.int64)
        i = np.arange(self.n, dtype=np.int64)
        return (ones - i) << self.low_bits | self._low(i)


class WordEncoder:
    """Ids of whole texts under a tokenizer whose pieces never cross white space; each distinct word is encoded once.

    Cutting at ASCII white space first is exact for such a tokenizer: its normaliser and splitter treat white
    space as a boundary that they drop. Whether the file is of that kind (it folds case, and texts of all sorts
    give the same ids in words as whole) is checked when it is loaded; any other tokenizer gets whole texts. Ids of words of Latin letters, with or without a final full stop or comma,
    come from the model alone, over the byte characters that the tokenizer gives each letter; all other words go
    through the whole tokenizer.
    """

    #: Letters that normalisation leaves alone but for their case (U+0130 is not among them).
    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([.,]?)")

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if width == 2 else "I"
        self.known: dict[bytes, bytes] = {}
        self.words = self._by_words()
        if not self.words:
            return
        self.tail = {"": [], **{x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in ".,"}}
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = {c for c in map(chr, range(65, 0x180)) if self.PLAIN.fullmatch(c)}
        self.bytes = {ord(c): "".join(part for part, _ in split(c)) for c in {x.lower() for x in letters}}

    def _by_words(self) -> bool:
        spec = json.loads(self.tokenizer.to_str())
        if '"Lowercase"' not in json.dumps(spec.get("normalizer")) or not spec.get("pre_tokenizer"):
            return False
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return all(ids(t) == [x for w in t.lower().split() for x in ids(w)] for t in PROBES)

    def _learn(self, words: list[bytes]) -> None:
        rest, piece, known, code = [], self.tokenizer.model.tokenize, self.known, self.code
        for w in words:
            if m := self.PLAIN.fullmatch(text := w.decode("utf-8", "surrogatepass")):
                known[w] = array(code, [t.id for t in piece(m[1].lower().translate(self.bytes))] + self.tail[m[2]]).tobytes()
            else:
                rest.append((w, text))
        for (w, _), e in zip(rest, self.tokenizer.encode_batch_fast([text for _, text in rest], add_special_tokens=False), strict=True):
            known[w] = array(code, e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.words:
            whole = [t.decode("utf-8", "surrogatepass") for t in texts]
            return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        # the tokenizer folds case; doing so first saves words, but could make one of its special tokens of a text
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        distinct = set().union(*split)
        fresh = [w for w in distinct if w not in self.known]
        if fresh and len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = list(distinct)
        self._learn(fresh)
        known = self.known
        return [b"".join([known[w] for w in s]) for s in split]


def encoder(path: str, width: int) -> WordEncoder:
    return kept(("words", path, width), lambda: WordEncoder(path, width))


STORE = "shard int, segment int, base long, n_docs int, n_ids long, width int, n_null int, first long, doc_ids binary, ids binary, bounds binary"


def _writer(path: str, width: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, segment, base = encoder(path, width).encode, TaskContext.get().partitionId(), 0, 0
        end = array("H" if width == 2 else "I", [end_id]).tobytes()
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, base, held
            ends = np.cumsum([len(p) // width for p in parts])
            known = np.array([d for d in docs if d is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            row = [shard, segment, base, len(docs), int(ends[-1]), width, len(docs) - len(known), first, EliasFano.encode(known - first).to_bytes(), b"".join(parts), EliasFano.encode(ends).to_bytes()]
            segment, base, held = segment + 1, base + int(ends[-1]), 0
            docs.clear()
            parts.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in STORE.split(", ")])

        for batch in blocks(batches):
            texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                if docs and (held + len(ids) // width + 1 > SEGMENT_IDS or len(docs) >= SEGMENT_DOCS):
                    yield flush()
                docs.append(doc_id)
                parts.append(ids + end)
                held += len(ids) // width + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: int, end_id: int = END_ID, name: str = "tokens") -> DataFrame:
    """Encode all documents in ascending doc_id order and write them to the shared folder; returns the segments as read back."""
    spark = docs.sparkSession
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(lean(_writer(path, width, end_id), ("words", path, width)), STORE), name)


def with_starts(segments: DataFrame) -> DataFrame:
    """Adds earlier_ids: ids of all segments before. One row per shard goes through one task; a shard is a partition of the writer."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    # one small row per partition of the writer
    return segments.join(F.broadcast(before), "shard").withColumn("earlier_ids", F.col("earlier") + F.col("base"))


class Segment:
    """The documents of a stored segment, by number."""

    def __init__(self, row: dict):
        self.n_null, self.first = row["n_null"], row["first"]
        self.doc_ids, self.bounds = EliasFano.from_bytes(row["doc_ids"]), EliasFano.from_bytes(row["bounds"])
        self.ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4")

    def __len__(self) -> int:
        return len(self.bounds)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.doc_ids[i - self.n_null]

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """(offset within the segment, ids) of document number i."""
        a = self.bounds[i - 1] if i else 0
        return a, self.ids[a : self.bounds[i]]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids without the null ones, ends within the segment) of all documents, by select."""
        return self.first + self.doc_ids.at(np.arange(len(self.doc_ids))), self.bounds.at(np.arange(len(self)))

    def find(self, doc_id: int) -> range:
        """Numbers of the documents of that id."""
        at = [bisect(range(len(self.doc_ids)), doc_id - self.first, key=self.doc_ids.__getitem__) for bisect in (bisect_left, bisect_right)]
        return range(self.n_null + at[0], self.n_null + at[1])


def read_digests(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Segment(row)
                known, ends = own.places()
                starts = np.append(0, ends[:-1])
                # four bytes for each id, whatever the width in the file
                ids = memoryview(own.ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc_ids = pa.concat_arrays([pa.nulls(own.n_null, pa.int64()), pa.array(known, pa.int64())])
                columns = [doc_ids, pa.array(row["earlier_ids"] + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_starts(segments).select("earlier_ids", "width", "n_null", "first", "doc_ids", "ids", "bounds").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
