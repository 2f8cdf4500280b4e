"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified, grouped.

Texts with equal words in equal order are one node from the start. A node's shingles are runs of five folded
words, weighed by term frequency times inverse document frequency, 1 + ln(documents / documents with the shingle). BANDS * ROWS
weighted samples are drawn per node; nodes that agree in all samples of a band share a bucket. Within a bucket nobody is paired with
everybody: each member is paired with one representative, pairs are verified by weighted Jaccard similarity on
the texts, and linked nodes become classes. Buckets whose members are still in several classes go through
further rounds, with HUBS other representatives each, while these link many of the pairs they try. Work per round is
linear in the members.

What is left then is compared in full: the members of buckets that still have several classes are dealt out by their
rarest shingles, as counted among these members, and the pairs of such a part that are in different classes, not tried yet and
may still be similar enough are verified. No such pair is lost: two texts are similar enough only if they share one of the shingles
that precede, from the rarest on, the last `similarity` of their weight, and only if few of their parity bits differ. So in the
end no bucket has a pair of similar texts in different classes.

Samples are drawn by the whole inverse document frequency, down to one in RARE documents: rarer shingles weigh as those. The pairs
that they bring together are verified by a tempered one, from one in COMMON documents on: a rarer shingle weighs 1 + TEMPER, one that
all documents have weighs 1, and in between the weight falls with the logarithm of the frequency. Untempered, the changed words of a
text that thousands of others copy would outweigh all that they share, and such copies would not count as similar. Frequencies come from
lossy counting over all documents: they are short by at most one in COUNTED documents, at every size, and there are at
most RARE shingles for each shingle of a mean document. Two texts always weigh a shingle alike.

Defined cases: null and empty texts, and texts without words, are one class; texts of fewer than five words have
one shingle, all their words; rows of one doc_id whose texts differ are different documents, each with the class of
its own text (two classes then may bear one number, but keep_one goes by rows); a null doc_id takes part under a hash of
its text; very long texts are sampled and compared whole; an empty table gives an empty result. The kept row of a class
has its least doc_id, then the least text; equal sample values take the least shingle.
Columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightspark.functions.components import connected_components
from freightspark.functions.shared import cut, discard
from freightspark.llm.common import U64, blocks, lean, mix, shingle_hashes, unused

WIDTH, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8**4)**12 = 0.2 %.
BANDS, ROWS = 12, 4
#: How much rarity weighs where pairs are verified, the share of documents (one in so many) from which a shingle is common there, and that by which counts may be short.
TEMPER, COMMON, COUNTED = 0.5, 128, 1024
#: The share of documents (one in so many) down to which inverse document frequency is told apart in the samples.
RARE = 512
#: Documents and shingles of a chunk that are counted together.
CHUNK_DOCS, CHUNK_SHINGLES = 4096, 1 << 20
#: Node keys that may be broadcast (8 bytes each); beyond, they are joined by a shuffle. Rounds with representatives at most.
KEY_BOUND, MAX_ROUNDS = 1_000_000, 12
#: Representatives of a bucket in each round after the first, which has the least node.
HUBS = 2
#: When a round links less than this share of its pairs, the rest is compared in full.
YIELD = 0.1
#: Members of a block in the full comparison, and pairs verified at once (or as many as there are texts, if that is more).
BLOCK, PAIR_BOUND = 512, 100_000
#: Texts that must hold a shingle for it to count as frequent, and the entries of the table of those (8 bytes each).
LEAST_SHARED, TABLE = 4, 2_000_000
#: Bits of a text where it meets others and afterwards, and the number of texts whose bits may be broadcast (528 bytes each).
FEW_BITS, BITS, BITMAP_BOUND = 1024, 4096, 50_000
#: Bounds are taken wider by this share, since sums of weights are rounded.
SLACK = 1e-6


def _counted(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text one after another, their counts, number of each text)."""
    runs, counts = shingle_hashes(texts, width)
    doc = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return runs[at], np.diff(np.append(at, len(runs))), np.bincount(doc[at], minlength=len(texts))


class Weights:
    """Weights of any shingle: of common ones from a table, the greatest of all others. `of` is for similarities, `idf` for samples."""

    def __init__(self, shingles: np.ndarray, weights: np.ndarray, temper: float = TEMPER, idf: np.ndarray | None = None):
        order = np.argsort(shingles)
        self.shingles, self.weights = shingles[order], np.append(weights[order], 1 + temper).astype(np.float32)
        self.idfs = self.weights if idf is None else np.append(idf[order], 1 + np.log(RARE)).astype(np.float32)

    def _from(self, table: np.ndarray, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.shingles, shingles)
        if not len(self.shingles):
            return np.full(len(shingles), table[-1])
        known = self.shingles[np.minimum(at, len(self.shingles) - 1)] == shingles
        return table[np.where(known, at, len(self.shingles))]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        return self._from(self.weights, shingles)

    def idf(self, shingles: np.ndarray) -> np.ndarray:
        return self._from(self.idfs, shingles)


def rarity(docs: DataFrame, width: int = WIDTH, temper: float = TEMPER) -> Weights:
    """Weights from the shares of all documents that hold a shingle.

    A shingle that a share of all documents holds is held by that share of some chunk of documents at least, so each
    chunk passes on what one in COUNTED of its documents holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n_full = n = size = 0

        def out(own: list[np.ndarray], n: int) -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(own), return_counts=True)
            often = counts * COUNTED >= n
            return pa.RecordBatch.from_arrays([pa.array(np.append(shingles[often].view(np.int64), 0)), pa.array(np.append(counts[often], n)), pa.array([False] * int(often.sum()) + [True])], names=["shingle", "n", "docs"])

        for batch in blocks(batches):
            shingles, _, _ = _counted([t or "" for t in batch.column("text").to_pylist()], width)
            held.append(shingles)
            n, size = n + batch.num_rows, size + len(shingles)
            if n >= CHUNK_DOCS or size >= CHUNK_SHINGLES:
                if full:
                    yield out(full, n_full)
                full, n_full, held, n, size = held, n, [], 0, 0
        # a rest of few documents would pass on all its shingles: it belongs to the chunk before
        if n_full + n:
            yield out(full + held, n_full + n)

    counts = docs.select("text").mapInArrow(lean(run), "shingle long, n long, docs boolean").groupBy("docs", "shingle").agg(F.sum("n").alias("n"))
    counts = cut(counts, "shingle-counts")
    n_docs = (counts.where("docs").select("n").first() or [0])[0]
    # all others weigh as one in RARE
    got = counts.where(~F.col("docs") & (F.col("n") * RARE > n_docs)).select("shingle", "n").toArrow()
    logs = np.log(n_docs / np.minimum(got.column("n").to_numpy(), n_docs)) if got.num_rows else np.zeros(0)
    return Weights(got.column("shingle").to_numpy().view(U64), 1 + temper * np.clip(logs / np.log(COMMON), 0, 1), temper, 1 + logs)


_QUANTILES = 1 << 16


def _gamma_table() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2: the root of 1 - (1 + x) exp(-x) = u, by Newton steps."""
    u = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    x = np.sqrt(2 * u)
    x = np.where(u > 0.5, -np.log1p(-u) + 1.5, x)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x) + 1e-300), 1e-9)
    return x


class Sampler:
    """Consistent weighted samples: equal for two weighted sets with the probability of their weighted Jaccard similarity."""

    def __init__(self, n: int):
        gamma = _gamma_table()
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.seeds = mix(np.arange(1, n + 1).astype(U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

    def draw(self, shingles: np.ndarray, log_weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(number of sets, number of samples) 64-bit codes; sets are runs of `counts` shingles, none of them empty."""
        first = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(counts)), counts)
        out = np.zeros((len(counts), len(self.seeds)), U64)
        for k, seed in enumerate(self.seeds):
            h = shingles * seed
            h ^= h >> U64(29)
            h *= U64(0xBF58476D1CE4E5B9)
            r = self.r[(h >> U64(48)).astype(np.int64)]
            beta = ((h >> U64(16)) & U64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_weight / r + beta)
            value = self.log_c[((h >> U64(32)) & U64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
            best = np.flatnonzero(value == np.minimum.reduceat(value, first)[of])
            at = np.zeros(len(counts), np.int64)
            at[of[best[::-1]]] = best[::-1]  # ties: the least shingle
            out[:, k] = mix(shingles[at] + t[at].astype(np.int64).astype(U64) * U64(0xD6E8FEB86659FD93))
        return out


def _node() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))


def _words_digest(runs: np.ndarray, n: int) -> bytes:
    import hashlib

    return hashlib.blake2b(runs.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest()


def signatures(docs: DataFrame, weights: Weights, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, digest, bands): digest is equal for equal word sequences; bands are hashes of `rows` samples each."""
    known = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weights = Sampler(bands * rows), known.value
        for batch in blocks(batches, limit=1 << 19):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            in_order, lengths = shingle_hashes(texts, width)
            ends = np.cumsum(lengths)
            digests = [_words_digest(in_order[a:b], b - a) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            shingles, times, counts = _counted(texts, width)
            full = np.flatnonzero(counts)
            codes = np.zeros((len(texts), bands * rows), U64)
            if len(full):
                codes[full] = sampler.draw(shingles, np.log(weights.idf(shingles) * times).astype(np.float32), counts[full])
            keys = np.zeros((len(texts), bands), U64)
            for k in range(rows):
                keys = mix(keys * U64(0x9E3779B97F4A7C15) + codes[:, k::rows])
            keys = mix(keys + np.arange(bands).astype(U64))
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(digests, pa.binary()), packed], names=["node", "digest", "bands"])

    return docs.select(_node().alias("node"), "text").mapInArrow(lean(run), "node long, digest binary, bands array<long>")


def weighted_jaccard(a: list[str], b: list[str], weights: Weights, width: int = WIDTH) -> np.ndarray:
    """Sum of the least over sum of the greatest weights of each pair of texts; two texts without words are equal."""
    parts = []
    for texts in (a, b):
        s, n, counts = _counted(texts, width)
        parts.append((np.repeat(np.arange(len(texts)), counts), s, weights.of(s).astype(np.float64) * n))
    pair, s, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((s, pair))
    pair, s, w = pair[order], s[order], w[order]
    total = np.bincount(pair, w, minlength=len(a))
    both = (pair[1:] == pair[:-1]) & (s[1:] == s[:-1])
    shared = np.bincount(pair[1:][both], np.minimum(w[1:], w[:-1])[both], minlength=len(a))
    return np.where(total > 0, shared / np.maximum(total - shared, 1e-300), 1.0)


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float, width: int) -> DataFrame:
    """(u, v) of the pairs that are similar enough, by their texts."""
    known = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "a", 1 << 20):
            same = weighted_jaccard(batch.column("a").to_pylist(), batch.column("b").to_pylist(), known.value, width)
            yield batch.select(["u", "v"]).filter(pa.array(same >= similarity))

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(lean(run), "u long, v long")


def parities(counted: tuple[np.ndarray, np.ndarray, np.ndarray], weights: Weights, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each text, `bits` bits of it as words): how many of its shingles of the greatest weight fall on a bit, odd or even.

    Every bit in which two texts differ is at least one shingle that only one of them has.
    """
    s, n, counts = counted
    w, doc = weights.of(s), np.repeat(np.arange(len(counts)), counts)
    rare = w == weights.weights[-1]
    odd = np.bincount(doc[rare] * bits + (s[rare] >> U64(8)).astype(np.int64) % bits, minlength=len(counts) * bits).astype(np.uint8) & 1
    return np.bincount(doc, w.astype(np.float64) * n, minlength=len(counts)), np.packbits(odd.reshape(len(counts), bits), axis=1).view(U64)


def _lists(words: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]), pa.array(np.ascontiguousarray(words).view(np.int64).ravel()))


class Frequent:
    """How many of the compared texts hold a shingle, by 32 bits of it: 0 if they are too few for the table."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.counts = np.append(ids[order], np.uint32(0xFFFFFFFF)), np.append(counts[order], 0)

    @staticmethod
    def fold(shingles: np.ndarray) -> np.ndarray:
        return (shingles >> U64(32)).astype(np.uint32)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        ids = self.fold(shingles)
        at = np.searchsorted(self.ids[:-1], ids)
        return np.where(self.ids[at] == ids, self.counts[at], 0)


def frequent(texts: DataFrame, width: int) -> Frequent:
    """The shingles that at least LEAST_SHARED texts hold; if these are more than TABLE, those of the most texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=CHUNK_SHINGLES * 8):
            ids, n = np.unique(Frequent.fold(_counted(batch.column("text").to_pylist(), width)[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int32)), pa.array(n.astype(np.int32))], names=["id", "n"])

    counts = texts.select("text").mapInArrow(lean(run), "id int, n int").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SHARED)
    counts = cut(counts, "frequent")
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()}
    power = max(sizes, default=0)
    while power - 1 in sizes and sum(n for p, n in sizes.items() if p >= power - 1) <= TABLE:
        power -= 1
    got = counts.where(F.col("n") >= 1 << power).toArrow()
    discard(counts)
    return Frequent(got.column("id").to_numpy().view(np.uint32), got.column("n").to_numpy())


def leading(texts: list[str], weights: Weights, often: Frequent, similarity: float, width: int) -> tuple[np.ndarray, ...]:
    """(number of the text, shingle, weight of the text, weight from the shingle on, shingle before it or 0) of the rarest shingles.

    Without one in common two texts are less similar. The order is the same for all texts. A shingle leads while it and those after
    it hold `similarity` of the text's weight.
    """
    s, n, counts = _counted(texts, width)
    w = weights.of(s).astype(np.float64)
    doc = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((s, -w, often.of(s), doc))
    own = (w * n)[order]
    total = np.bincount(doc, own, minlength=len(texts))[doc]
    before, full = np.cumsum(own) - own, counts > 0
    before -= np.repeat(before[(np.cumsum(counts) - counts)[full]], counts[full])
    lead = total - before >= similarity * total * (1 - SLACK)
    s = s[order]
    previous = np.append(U64(0), s[:-1])[: len(s)]
    previous[(np.cumsum(counts) - counts)[full]] = 0
    return doc[lead], s[lead], total[lead], (total - before)[lead], previous[lead]


def _leading(texts: DataFrame, weights: Weights, often: Frequent, similarity: float, width: int) -> DataFrame:
    """(node, shingle, total, rest, previous, bits) of the leading shingles of each text."""
    known = texts.sparkSession.sparkContext.broadcast((weights, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = batch.column("text").to_pylist()
            bits = parities(_counted(texts, width), known.value[0], FEW_BITS)[1]
            at, shingles, total, rest, previous = leading(texts, *known.value, similarity, width)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at)), pa.array(shingles.view(np.int64)), pa.array(total), pa.array(rest), pa.array(previous.view(np.int64)), _lists(bits[at])], names=["node", "shingle", "total", "rest", "previous", "bits"])

    return texts.select("node", "text").mapInArrow(lean(run), "node long, shingle long, total double, rest double, previous long, bits array<long>")


def _bitmaps(texts: DataFrame, weights: Weights, width: int) -> DataFrame:
    """(node, total, bits)."""
    known = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            total, bits = parities(_counted(batch.column("text").to_pylist(), width), known.value, BITS)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(total), _lists(bits)], names=["node", "total", "bits"])

    return texts.select("node", "text").mapInArrow(lean(run), "node long, total double, bits array<long>")


def _left_over(now: DataFrame, mixed: DataFrame, texts: DataFrame, weights: Weights, similarity: float, width: int) -> DataFrame:
    """(u, v): every pair of texts of mixed buckets that are in different classes and may be similar enough.

    now: (key, rep, label); mixed: the keys of buckets with several classes. A part is a leading shingle; its texts
    are dealt to blocks, and each pair of blocks is a group of its own. Pairs whose bits differ by more than those of similar
    texts of their weights can are left out, by few bits where they meet and by more bits afterwards.
    """
    own = cut(now.join(mixed, "key").select("rep", "label").distinct(), "mixed")
    compared = cut(texts.join(own.select(F.col("rep").alias("node")), "node", "left_semi"), "compared")
    lead = _leading(compared, weights, frequent(compared, width), similarity, width)
    rows = cut(lead.join(own, lead.node == own.rep).select(F.col("shingle").alias("part"), "rep", "label", "total", "rest", "previous", "bits"), "parts")
    size = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a != b")
    dealt = rows.join(size.select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("n")), "part")
    every, mine = F.explode(F.sequence(F.lit(0), F.col("n") - 1)), F.pmod(F.xxhash64("rep"), F.col("n").cast("long")).cast("int")
    end = lambda e, i, j: dealt.select("part", i.alias("i"), j.alias("j"), *[F.col(c).alias(f"{c[0]}{e}") for c in ("rep", "label", "total")], F.col("rest").alias(f"after{e}"), F.col("previous").alias(f"previous{e}"), F.col("bits").alias(f"bits{e}"))
    # all that two texts share lies from their first common shingle on, and later ones have less after them
    near = F.least("afteru", "afterv") >= similarity / (1 + similarity) * (1 - SLACK) * (F.col("tu") + F.col("tv"))
    first = (F.col("previousu") != F.col("previousv")) | (F.col("previousu") == 0)
    # what only one of two similar texts has weighs no more than this
    most = (1 - similarity) / (1 + similarity) * (1 + SLACK) * (F.col("tu") + F.col("tv"))
    alike = float(weights.weights[-1]) * reduce(Column.__add__, [F.bit_count(F.col("bitsu")[k].bitwiseXOR(F.col("bitsv")[k])) for k in range(FEW_BITS // 64)]) <= most
    met = end("u", mine, every).join(end("v", every, mine), ["part", "i", "j"]).where((F.col("ru") < F.col("rv")) & (F.col("lu") != F.col("lv")) & near & first & alike)
    pairs = cut(met.select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "left-over")
    bits = cut(_bitmaps(compared, weights, width), "bitmaps")
    known = F.broadcast(bits) if bits.count() <= BITMAP_BOUND else bits
    for e in ("u", "v"):
        pairs = pairs.join(known.select(F.col("node").alias(e), F.col("total").alias(f"t{e}"), F.col("bits").alias(f"b{e}")), e)
    differ = F.aggregate(F.zip_with("bu", "bv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda x, y: x + y)
    found = cut(pairs.where(differ * float(weights.weights[-1]) <= most).select("u", "v"), "near-enough")
    for used in (own, compared, rows, bits):
        discard(used)
    return found


def _labelled(member: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, rep, label): the class of each member so far."""
    if labels is None:
        return member.withColumn("label", F.col("rep"))
    return member.join(labels, member.rep == labels.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different classes so far."""
    if labels is None:
        return pairs
    for e in ("u", "v"):
        pairs = pairs.join(labels.select(F.col("node").alias(e), F.col("component").alias(f"c{e}")), e, "left")
    return pairs.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, component) after new links: components of the old classes that they join, not of all links again."""
    if labels is None:
        return connected_components(found)
    ends = found
    for e in ("u", "v"):
        own = labels.select(F.col("node").alias(e), F.col("component").alias(f"c{e}"))
        ends = ends.join(own, e, "left").withColumn(e, F.coalesce(f"c{e}", e)).drop(f"c{e}")
    joined = connected_components(ends).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = labels.join(joined, labels.component == joined.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = joined.join(labels.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return moved.union(fresh)


def _digested(docs: DataFrame, width: int) -> DataFrame:
    """(node, digest, text): the digests of signatures(), for some of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            runs, lengths = shingle_hashes(batch.column("text").to_pylist(), width)
            ends = np.cumsum(lengths)
            digests = [_words_digest(runs[a:b], b - a) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(digests, pa.binary()), batch.column("text")], names=["node", "digest", "text"])

    return docs.mapInArrow(lean(run), "node long, digest binary, text string")


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= KEY_BOUND else keys


def class_rows(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, digest, class_id, first, n_verified) for every row: `first` is the digest of the text that stays for the class.

    Texts are told apart by their digests and numbered, so rows of one doc_id with different texts are different
    documents. The text that stays has the least doc_id of the class, then the least digest. Work on copies is done once.
    """
    weights = rarity(docs, width)
    signed = cut(signatures(docs, weights, width, bands, rows), "signatures")
    # one node for all rows of a word sequence
    exact = signed.groupBy("digest").agg(F.min("node").alias("doc"), F.first("bands").alias("bands"))
    exact = cut(exact.withColumn("rep", F.monotonically_increasing_id()), "texts")
    member = exact.select("rep", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    member = cut(member.join(shared, "key").distinct(), "members")
    reps = exact.select("rep", "doc", "digest").join(member.select("rep").distinct(), "rep", "left_semi")
    own = docs.select(_node().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    own = _digested(own.join(_few(reps.select(F.col("doc").alias("node")).distinct()), "node", "left_semi"), width)
    texts = own.join(reps.withColumnRenamed("doc", "node"), ["node", "digest"]).groupBy(F.col("rep").alias("node")).agg(F.min("text").alias("text"))
    texts = cut(texts, "candidate-texts")
    links = tried = labels = None
    used = [signed, exact, member, texts]

    def merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
        return cut(_relabelled(labels, found), "classes", replaces=labels)

    for turn in range(MAX_ROUNDS):
        now = _labelled(member, labels)
        orders = [F.col("rep")] if labels is None else [F.xxhash64(F.lit(turn), F.lit(h), "key", "rep") for h in range(HUBS)]
        hubs = F.array_distinct(F.array(*[F.min_by(F.struct("rep", "label"), o) for o in orders])).alias("hubs")
        chosen = now.groupBy("key").agg(hubs, F.min("label").alias("a"), F.max("label").alias("b")).where("a != b")
        # written, so that a key with very many members is split in the join
        chosen = cut(chosen.select("key", "hubs"), "hubs")
        pairs = now.join(chosen, "key").select("rep", "label", F.explode("hubs").alias("hub")).where("label != hub.label")
        pairs = pairs.select(F.least("rep", "hub.rep").alias("u"), F.greatest("rep", "hub.rep").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = cut(pairs, "pairs", replaces=chosen)
        used.append(pairs)
        n_pairs = pairs.count()
        if not n_pairs:
            break
        found = cut(_verified(pairs, texts, weights, similarity, width), "links")
        used.append(found)
        tried = pairs if tried is None else tried.union(pairs)
        if n_found := found.count():
            links = found if links is None else links.union(found)
            labels = merged(labels, found)
        if turn and n_found < YIELD * n_pairs:
            break
    now = _labelled(member, labels)
    mixed = cut(now.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key"), "mixed-keys")
    used.append(mixed)
    if not mixed.isEmpty():
        left = _left_over(now, mixed, texts, weights, similarity, width)
        rest = cut(left if tried is None else left.join(tried, ["u", "v"], "left_anti"), "rest", replaces=left)
        used.append(rest)
        n_parts = -(-rest.count() // max(PAIR_BOUND, texts.count()))
        for k in range(n_parts):
            # what the parts before have linked is not compared again
            part = _apart(rest.where(F.pmod(F.xxhash64("u", "v"), F.lit(n_parts)) == k), labels)
            found = cut(_verified(part, texts, weights, similarity, width), "links")
            used.append(found)
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                labels = merged(labels, found)
    by_text = exact.select("digest", "rep", "doc")
    if labels is not None:
        ends = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_verified"))
        linked = by_text.join(labels.withColumnRenamed("node", "rep"), "rep")
        firsts = linked.groupBy("component").agg(F.min(F.struct("doc", "digest")).alias("first"))
        linked = linked.join(firsts, "component").join(ends, "rep", "left").select("rep", "first", "n_verified")
        by_text = by_text.join(linked, "rep", "left").select("digest", F.coalesce("first.doc", "doc").alias("class_id"), F.coalesce("first.digest", "digest").alias("first"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    else:
        by_text = by_text.select("digest", F.col("doc").alias("class_id"), F.col("digest").alias("first"), F.lit(0).cast("long").alias("n_verified"))
    out = cut(signed.select("node", "digest").join(by_text, "digest").select("node", "digest", "class_id", "first", "n_verified"), "class-rows")
    for table in [*used, *([labels] if labels is not None else [])]:
        discard(table)
    return out


def classes(docs: DataFrame, **how) -> DataFrame:
    """(node, class_id, n_verified) for every row: node is its doc_id, class_id the least doc_id of its class.

    n_verified: links to different texts that were verified on the way to the classes, not all that there are: pairs
    within a class are not tried again.
    """
    return class_rows(docs, **how).select("node", "class_id", "n_verified")


def keep_one(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """One row of each class; all columns kept: that with the least doc_id, then the least digest, then the least text and other columns."""
    found = class_rows(docs, width=width, **how)
    names, orders = docs.columns, [f.name for f in docs.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    node, digest = unused("node", names), unused("digest", names)
    stays = (F.col("node") == F.col("class_id")) & (F.col("digest") == F.col("first"))
    by_node = cut(found.groupBy(F.col("node").alias(node)).agg(F.count("*").alias("n"), F.max(stays).alias("stays")).where("n > 1 or not stays"), "node-rows")
    rows = docs.withColumn(node, _node())
    once = rows.join(_few(by_node.select(node)), node, "left_anti").select(*names)
    # rows that share their doc_id with others are told apart by their texts
    often = _few(by_node.where("n > 1 and stays").select(node))
    some = rows.join(often, node, "left_semi")
    keys = found.where(stays).join(often, found.node == often[node], "left_semi").select(F.col("node").alias(node), F.col("digest").alias(digest)).distinct()
    digests = _digested(some.select(F.col(node).alias("node"), F.coalesce("text", F.lit("")).alias("text")).distinct(), width)
    kept = digests.select(F.col("node").alias(node), F.col("digest").alias(digest), F.col("text").alias("kept_text")).join(keys, [node, digest], "left_semi")
    kept = kept.groupBy(node, digest).agg(F.min("kept_text").alias("kept_text")).select(F.col(node).alias("kept_node"), "kept_text")
    least = some.join(kept, (F.col(node) == F.col("kept_node")) & (F.coalesce(some["text"], F.lit("")) == F.col("kept_text")), "inner")
    least = least.groupBy("kept_node", "kept_text").agg(F.min_by(F.struct(*[some[c] for c in names]), F.struct(*[some[c] for c in orders])).alias("row"))
    return once.unionByName(least.select("row.*"))
