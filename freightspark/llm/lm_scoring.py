"""Language-model scoring by context-tree weighting over bytes, beside a unigram base.

A text is scored as its token sequence: A-Z lower-cased, words joined by one space, a line break at the end. Each
byte is a few binary decisions, those of a Huffman code of the training bytes. The context of a decision is the
decisions before it in its byte and up to DEPTH bytes before that (line breaks stand before the start). Contexts
hold counts of both outcomes; their Krichevsky-Trofimov estimates are mixed over all depths by the weights of
context-tree weighting. A context belongs to the tree if training has it at least LEAST times, whatever the size of the corpus; the
rarer ones below a context share one leaf, so no count is dropped.

The byte runs of all texts, with their counts in training, are dealt by their nearest CUT bytes: a task holds whole subtrees (of at most
256**(DEPTH - CUT) contexts below each root), and only the contexts of fewer bytes, 1 + 256 + 256**2 at most, go
through the driver. There each run gets its log probability, from the longest of its contexts in the tree; a byte that
was not seen there costs the context's escape, which shares out the rest of its probability as the context one
byte shorter does. Runs that make up at least 1 / HOT_RUNS of all bytes, so at most HOT_RUNS, are looked up in the tasks; all rarer ones meet
their values in a join by run. Which way a run goes changes no score beyond the rounding of sums.

Words with at least 1 / HOT_WORDS of all tokens, so at most HOT_WORDS, are looked up in the tasks; all rarer ones
meet their counts in a join by word.

Defined cases: a null text is an empty text, which has the end token only; an empty training fold gives a base
of log10(1 / V) over nothing, that is 0, and a model of undecided decisions; repeated rows give repeated rows
(sums are kept by doc_id and a checksum of the text); very long texts are read whole, in pieces. Only doc_id and
text are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.functions.shared import cut
from freightspark.llm.common import blocks, lean, remainder

DEPTH, CUT, HOT_WORDS, LEAST = 5, 3, 100_000, 2
#: Distinct words or byte runs that a task holds before it passes its counts on, and rows of a block of subtrees.
HELD_WORDS, HELD_RUNS, BLOCK_ROWS = 150_000, 1 << 20, 1 << 17
#: Runs that a task looks up at most (about 24 bytes each), and bytes of text scored at once.
HOT_RUNS, PIECE = 4_000_000, 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() folds A-Z alone, and bytes.split() cuts at 0x20 and 0x09-0x0D alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
            count.clear()
            return out

        for batch in blocks(batches):
            for text in batch.column("text").to_pylist():
                count.update(words_of(text))
            if len(count) > HELD_WORDS:
                yield flush()
        if count:
            yield flush()

    return docs.select("text").mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def streams(words: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, number of the text) of the bytes of texts, PIECE at a time. A code has the byte in its low eight bits, the byte before it in the next, and so on."""
    lead = b"\n" * DEPTH
    parts = [lead + b" ".join(w) + b"\n" for w in words]
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    own = np.ones(len(data), bool)
    own[((np.cumsum(sizes) - sizes)[:, None] + np.arange(DEPTH)).ravel()] = False
    limits = np.cumsum(sizes)
    for start in range(DEPTH, len(data), PIECE):
        at = start + np.flatnonzero(own[start : start + PIECE])
        near = data[start - DEPTH : start + PIECE].astype(np.int64)
        code = np.zeros(len(at), np.int64)
        for k in range(DEPTH + 1):
            code |= near[at - k - start + DEPTH] << (8 * k)
        yield code, np.searchsorted(limits, at, side="right")


def _run_counts(docs: DataFrame) -> DataFrame:
    """(code, n, every): byte runs of all texts, with their counts in those of the training fold and in all. docs: (text, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            codes, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return codes, *(np.bincount(inverse, np.concatenate([h[i] for h in held])).astype(np.int64) for i in (1, 2))

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["code", "n", "every"])

        for batch in blocks(batches):
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            texts = batch.column("text").to_pylist()
            for fold in (True, False):
                for code, _ in streams([words_of(texts[i]) for i in np.flatnonzero(train == fold)]):
                    codes, n = np.unique(code, return_counts=True)
                    held.append((codes, n * fold, n))
            if sum(len(h[0]) for h in held) > HELD_RUNS:
                held = [merged()]
                if len(held[0][0]) > HELD_RUNS // 2:
                    yield out(held.pop())
        if held:
            yield out(merged())

    return docs.select("text", "train").mapInArrow(lean(run), "code long, n long, every long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument by six."""
    shift = np.log(x)
    for k in range(1, 6):
        shift = shift + np.log(x + k)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - shift


@dataclass
class Decisions:
    """The binary decisions that make up each byte, from a Huffman code of the counts: frequent bytes take few.

    Those of byte b are number[start[b] : start[b] + count[b]], which come out as outcome[...] (0 or 1).
    """

    start: np.ndarray
    count: np.ndarray
    number: np.ndarray
    outcome: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Decisions:
        heap = [(float(c) + 0.01, b, [b]) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        paths: list[list[tuple[int, int]]] = [[] for _ in counts]
        for k in range(len(counts) - 1):
            (c, i, left), (m, j, right) = heapq.heappop(heap), heapq.heappop(heap)
            for side, symbols in enumerate((left, right)):
                for b in symbols:
                    paths[b].append((len(counts) - 2 - k, side))
            heapq.heappush(heap, (c + m, min(i, j), left + right))
        count = np.array([len(p) for p in paths])
        number, outcome = (np.array([x[side] for p in paths for x in reversed(p)], np.int64) for side in (0, 1))
        return cls(np.cumsum(count) - count, count, number, outcome)

    def each(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the byte in the array, decision, outcome) of all decisions of all bytes."""
        n = self.count[byte]
        of = np.repeat(np.arange(len(byte)), n)
        at = self.start[byte][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, self.number[at], self.outcome[at]


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1)


def short(codes: np.ndarray, depth: int) -> np.ndarray:
    """The codes with contexts of `depth` bytes."""
    return codes & ((1 << (8 * (depth + 1))) - 1)


class Level:
    """The tree's contexts of one depth: node = context * 256 + decision, ascending, with counts of both outcomes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int, how: Decisions, least: float):
        self.depth = depth
        codes, inverse = np.unique(short(codes, depth), return_inverse=True)
        n = np.bincount(inverse, n, minlength=len(codes))
        _, of = np.unique(codes >> 8, return_inverse=True)
        often = np.bincount(of, n)[of] >= least if depth else np.ones(len(codes), bool)
        #: Bytes seen in each context, as codes.
        self.codes = codes = codes[often]
        of, number, outcome = how.each(codes & 255)
        self.node, inverse = np.unique((codes >> 8)[of] << 8 | number, return_inverse=True)
        times = n[often][of].astype(np.float64)
        self.ones = np.bincount(inverse, times * outcome, minlength=len(self.node))
        self.zeros = np.bincount(inverse, times * (1 - outcome), minlength=len(self.node))

    def parents(self) -> np.ndarray:
        """Nodes one byte shorter."""
        return short(self.node >> 8, self.depth - 2) << 8 | self.node & 255 if self.depth > 1 else self.node & 255

    def place(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.node, nodes)

    def weigh(self, below: tuple[np.ndarray, ...] | None) -> None:
        """below: (this level's nodes, log probabilities, zeros, ones) of the longer contexts, None at the greatest depth.

        Sets the log probability under the mixture, the share of the node's own estimate in it, and the estimate of the leaf of rare longer contexts.
        """
        own = _kt(self.zeros, self.ones)
        self.log, self.share, self.rare = own, np.ones(len(own)), self.estimate()
        if below is not None:
            at = self.place(below[0])
            logs, zeros, ones = (np.bincount(at, x, minlength=len(own)) for x in below[1:])
            zeros, ones = self.zeros - zeros, self.ones - ones
            self.log = np.logaddexp(own, logs + _kt(zeros, ones)) - np.log(2)
            self.share = np.exp(own - np.log(2) - self.log)
            self.rare = np.where(zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1), self.rare)

    def estimate(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def mix(self, above: Level | None) -> None:
        """above: the level one byte shorter, mixed. Sets leaf, the probability of a one where no longer context is in the tree."""
        mixed, rest = (0.0, 1.0) if above is None else (x[above.place(self.parents())] for x in (above.mixed, above.rest))
        self.mixed, self.rest = mixed + rest * self.share * self.estimate(), rest * (1 - self.share)
        self.leaf = self.mixed + self.rest * self.rare

    def probabilities(self, codes: np.ndarray, how: Decisions) -> np.ndarray:
        """Of each byte in its context; decisions that the context has not seen are open."""
        of, number, outcome = how.each(codes & 255)
        want = (short(codes, self.depth) >> 8)[of] << 8 | number
        at = np.minimum(self.place(want), max(0, len(self.node) - 1))
        one = np.where(self.node[at] == want, self.leaf[at], 0.5) if len(self.node) else np.full(len(of), 0.5)
        return np.exp(np.bincount(of, np.log(np.clip(np.where(outcome == 1, one, 1 - one), 1e-12, 1)), minlength=len(codes)))


def tree(codes: np.ndarray, n: np.ndarray, how: Decisions, least: float, depths: range, below: tuple[np.ndarray, ...] | None = None) -> list[Level]:
    """Levels of the given depths, weighed, shortest first. below: see Level.weigh, for the last of them."""
    levels = [Level(codes, n, d, how, least) for d in depths]
    for level in reversed(levels):
        level.weigh(below)
        below = (level.parents(), level.log, level.zeros, level.ones)
    return levels


#: Keys of the table: the code, the depth above it, and for an escape the context instead of the code.
_DEPTH_BIT, _ESCAPE_BIT = 8 * (DEPTH + 1), 8 * (DEPTH + 1) + 4


def entries(levels: list[Level], above: Level | None, how: Decisions) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log10) of the bytes and escapes of mixed levels. above: the level one byte shorter."""
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for level in levels:
        d = level.depth
        codes = level.codes if d else np.arange(256)
        if not len(codes):
            break
        p = level.probabilities(codes, how)
        keys.append(codes | d << _DEPTH_BIT)
        values.append(np.log10(p))
        if d:
            contexts, of = np.unique(codes >> 8, return_inverse=True)
            left = 1 - np.bincount(of, p)
            there = 1 - np.bincount(of, above.probabilities(short(codes, d - 1), how))
            keys.append(contexts | d << _DEPTH_BIT | 1 << _ESCAPE_BIT)
            values.append(np.log10(np.maximum(left, 1e-12)) - np.log10(np.maximum(there, 1e-12)))
        above = level
    return np.concatenate(keys), np.concatenate(values)


class Table:
    """Entries by key: sorted by a hash, with the start of each hash's entries."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        h = self._hash(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = np.append(keys[order], -1), np.append(values[order], 0).astype(np.float32)
        counts = np.bincount(h, minlength=1 << self.bits)
        self.start = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        self.longest = int(counts.max(initial=0))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its value or 0)."""
        at = self.start[self._hash(keys)]
        found = self.keys[at] == keys
        for _ in range(1, self.longest):
            todo = np.flatnonzero(~found)
            if not len(todo):
                break
            at[todo] = np.minimum(at[todo] + 1, len(self.keys) - 1)
            found[todo] = self.keys[at[todo]] == keys[todo]
        return found, np.where(found, self.values[at], np.float32(0))

    def log10(self, codes: np.ndarray, above: Table | None = None) -> np.ndarray:
        """log10 of each byte in its context of DEPTH bytes, from the longest context in the tree. above: what has the contexts below CUT bytes."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for d in range(DEPTH, -1, -1):
            at = self if above is None or d >= CUT else above
            own = short(codes[todo], d)
            found, value = at.find(own | d << _DEPTH_BIT)
            out[todo] += value
            todo, own = todo[~found], own[~found]
            if not len(todo):
                break
            out[todo] += at.find(own >> 8 | d << _DEPTH_BIT | 1 << _ESCAPE_BIT)[1]
        return out


def _subtree_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, counts in training, counts in all texts) of whole subtrees, about BLOCK_ROWS at once."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("root", "code", "n", "every")]))
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            rows = np.concatenate(held, 1)
            start = int(np.searchsorted(rows[0], rows[0, -1]))
            if start:
                yield rows[1, :start], rows[2, :start], rows[3, :start]
            # what is kept doesn't count, so that a large subtree isn't gone through for every batch
            held, size = [rows[:, start:]], 0
    if held:
        rows = np.concatenate(held, 1)
        yield rows[1], rows[2], rows[3]


def _dealt(runs: DataFrame) -> DataFrame:
    root = F.shiftright("code", 8).bitwiseAND((1 << (8 * CUT)) - 1).alias("root")
    return runs.select(root, "code", "n", "every").repartition("root").sortWithinPartitions("root")


def fit(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(code, every, value): the log10 of every byte run of the texts under the tree of those in the training fold, and how often all texts have it. docs: (text, train)."""
    spark = docs.sparkSession
    runs = cut(_run_counts(docs), "byte-runs")
    learned = runs.where("n > 0")
    # at most 256**CUT rows
    near = learned.groupBy(F.col("code").bitwiseAND((1 << (8 * CUT)) - 1).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    codes, n = near.column("code").to_numpy(), near.column("n").to_numpy()
    how = Decisions.of(np.bincount(codes & 255, n, minlength=256))
    depths = range(CUT, DEPTH + 1)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n, _ in _subtree_blocks(batches):
            root = tree(codes, n, how, least, depths)[0]
            nodes, of = np.unique(root.parents(), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.array(np.bincount(of, x, minlength=len(nodes))) for x in (root.log, root.zeros, root.ones))], names=["node", "log", "zeros", "ones"])

    sums = _dealt(learned).mapInArrow(lean(up), "node long, log double, zeros double, ones double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("log", "zeros", "ones")])
    sums = sums.toArrow()
    top = tree(codes, n, how, least, range(CUT), tuple(sums.column(c).to_numpy() for c in ("node", "log", "zeros", "ones")))
    for above, level in zip([None, *top], top, strict=False):
        level.mix(above)
    known = spark.sparkContext.broadcast((how, top[-1], Table(*entries(top, None, how))))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, last, first = known.value
        for codes, n, every in _subtree_blocks(batches):
            in_training = n > 0
            levels = tree(codes[in_training], n[in_training], how, least, depths) if in_training.any() else []
            for above, level in zip([last, *levels], levels, strict=False):
                level.mix(above)
            own = Table(*entries(levels, last, how))
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(every), pa.array(own.log10(codes, first))], names=["code", "every", "value"])

    return cut(_dealt(runs).mapInArrow(lean(down), "code long, every long, value double"), "run-values")


def _part_of(codes: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of the table that has a code's contexts of two bytes and more: by the nearest two bytes."""
    return ((codes >> 8) & 0xFFFF) * 40503 % 65521 % n_parts


def text_scores(table: Table, words: list[list[bytes]], part: int = 0, n_parts: int = 1) -> np.ndarray:
    """log10 of each text from the entries of a tree, of the bytes that belong to the part: what the values of its runs add up to."""
    out = np.zeros(len(words))
    for codes, of in streams(words):
        if n_parts > 1:
            own = _part_of(codes, n_parts) == part
            codes, of = codes[own], of[own]
        out += np.bincount(of, table.log10(codes), minlength=len(words))
    return out


#: Before the eight bytes of a run, where words and runs are keys of one join: no word has a space.
RUN_MARK = b"  "


def _run_keys(codes: np.ndarray) -> pa.Array:
    """The runs as keys."""
    size = len(RUN_MARK) + 8
    data = np.empty((len(codes), size), np.uint8)
    data[:, : len(RUN_MARK)] = np.frombuffer(RUN_MARK, np.uint8)
    data[:, len(RUN_MARK) :] = codes.astype(">i8").view(np.uint8).reshape(-1, 8)
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, size * len(codes) + 1, size, dtype=np.int32)), pa.py_buffer(data)])


def _hot_scores(table: Table, words: list[list[bytes]]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(log10 of the runs of each text that the table has, (text, run, times) of the others). table: values of whole runs."""
    out, rest = np.zeros(len(words)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for codes, of in streams(words):
        found, value = table.find(codes)
        out += np.bincount(of, value, minlength=len(words))
        of, codes = of[~found], codes[~found]
        if len(of):
            order = np.lexsort((codes, of))
            of, codes = of[order], codes[order]
            first = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(codes) != 0)))
            rest.append((of[first], codes[first], np.diff(np.append(first, len(of))).astype(np.int32)))
    return out, tuple(np.concatenate(x) for x in zip(*rest, strict=True))


def _tags(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) - (1 << 31) for t in batch.column("text").to_pylist()], pa.int32())


def score(docs: DataFrame, fold: int = 7, held: int = 2, hot_words: int = HOT_WORDS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document; see the module."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    train = docs.where(remainder("doc_id", fold) != held)
    counts = cut(_word_counts(train), "word-counts")
    n_docs = train.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_docs, n_distinct + (n_docs > 0)
    often = counts.where(F.col("c") * hot_words >= total).toArrow()
    hot_logs = spark.sparkContext.broadcast(dict(zip(often.column("word").to_pylist(), np.log10(often.column("c").to_numpy() + 1.0).tolist(), strict=True)))
    end = float(np.log10(n_docs + 1))
    head_kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("n_bytes", pa.int64())])
    schema = "doc_id long, tag int, word binary, k int, lm double, head struct<n_tokens: long, n_known: long, base: double, n_bytes: long>"

    values = fit(docs.select("text", (remainder("doc_id", fold) != held).alias("train")))
    n_bytes = values.agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
    # at most hot_runs rows
    near = values.where(F.col("every") * hot_runs >= n_bytes).select("code", "value").toArrow()
    known = spark.sparkContext.broadcast(Table(near.column("code").to_numpy(), near.column("value").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot = known.value, hot_logs.value
        for batch in blocks(batches):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            lms, rare = _hot_scores(table, words)
            rows, keys, times, heads = list(range(len(words))), [None] * len(words), [0] * len(words), [None] * len(words)
            for row, own in enumerate(words):
                n_hot, base = int(n_docs > 0), end
                for w, k in Counter(own).items():
                    if (v := hot.get(w)) is not None:
                        n_hot += k
                        base += k * v
                    else:
                        rows.append(row)
                        keys.append(w)
                        times.append(k)
                # a key that no word can have, so that these rows don't meet in one task
                keys[row] = b" %d" % row
                heads[row] = {"n_tokens": len(own) + 1, "n_known": n_hot, "base": base, "n_bytes": sum(map(len, own)) + max(1, len(own))}
            none = len(rows) - len(words) + len(rare[0])
            of = pa.array(np.concatenate([np.array(rows, np.int64), rare[0]]))
            columns = [batch.column("doc_id").cast(pa.int64()).take(of), _tags(batch).take(of), pa.concat_arrays([pa.array(keys, pa.binary()), _run_keys(rare[1])]), pa.array(np.concatenate([np.array(times, np.int32), rare[2]]))]
            columns += [pa.array(np.append(lms, np.zeros(none))), pa.array(heads + [None] * none, head_kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "word", "k", "lm", "head"])

    # a word's count or a run's value
    rare_runs = values.where(F.col("every") * hot_runs < n_bytes).select(F.concat(F.lit(RUN_MARK), F.unhex(F.lpad(F.hex("code"), 16, "0"))).alias("word"), F.lit(None).cast("long").alias("c"), "value")
    rare_words = counts.where(F.col("c") * hot_words < total).withColumn("value", F.lit(None).cast("double"))
    rows = docs.mapInArrow(lean(run), schema).join(rare_words.unionByName(rare_runs), "word", "left")
    sums = rows.groupBy("doc_id", "tag").agg(
        F.count("head").alias("m"),
        F.first("head", ignorenulls=True).alias("h"),
        F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("k"))), F.lit(0)).alias("n_rare"),
        F.coalesce(F.sum(F.col("k") * F.log10(F.col("c") + 1)), F.lit(0.0)).alias("base"),
        F.sum(F.col("lm") + F.coalesce(F.col("k") * F.col("value"), F.lit(0.0))).alias("lm"),
    )
    spread = float(np.log10(total + distinct + 1))
    once = sums.select(
        "doc_id",
        "h.n_tokens",
        (F.col("h.n_known") + (F.col("n_rare") / F.col("m")).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("h.base") + F.col("base") / F.col("m") - F.col("h.n_tokens") * spread).alias("base_score"),
        (F.col("lm") / F.col("m")).alias("score"),
        "h.n_bytes",
        F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy"),
    )
    return once.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
