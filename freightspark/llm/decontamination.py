"""Benchmark decontamination: spaced seeds join documents with benchmark items; overlaps are verified around hits.

A seed is a hash of some of the tokens in a short window: the fixed masks name the positions that count, so a
substituted token at an ignored position does not hide an overlap. A document and an item that share a seed are
aligned there, and the aligned tokens are compared one by one. DataFrame functions only.

Seeds of the benchmark are broadcast only in blocks of at most `block_items` items whose seeds are counted first;
a larger benchmark is gone through in several blocks. Document seeds are not shuffled.

Defined cases: null texts and texts without tokens never overlap; items of fewer than `min_tokens` tokens are not
searched for; rows that repeat give the same pairs once; null doc_id rows are held apart by their text; empty
tables give empty results. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightspark.functions.shared import cut
from freightspark.llm.common import unused

#: Positions that count in each mask (fixed values). Wherever the substitutions stand that MATCHES of WINDOW allow, also
#: in items of MIN_TOKENS to WINDOW tokens, one of these stays whole inside the window; a test goes through all cases.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 1, 4, 6, 8), (0, 3, 4, 5, 6))
SPAN = 1 + max(max(m) for m in MASKS)
WINDOW, MATCHES, MIN_TOKENS = 13, 10, 8
#: Seeds broadcast at once (about 40 bytes each), and documents whose keys may be broadcast.
SEED_BOUND, KEY_BOUND = 2_000_000, 500_000


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits; the first or last may be empty."""
    return F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+")


def _seeds(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """A row (keys, position, seed) for each window and mask. `t`: the hashes of the tokens."""
    shifted = F.arrays_zip(*[(F.col("t") if k == 0 else F.slice("t", k + 1, F.greatest(F.size("t"), F.lit(1)))).alias(f"w{k}") for k in range(SPAN)])
    windows = df.select(*keys, F.posexplode(shifted).alias(at, "w"))
    whole = [F.xxhash64(F.lit(m), *[F.col(f"w.w{k}") for k in mask]) for m, mask in enumerate(MASKS)]
    # beyond the end of the text a window has nulls; such seeds would match by chance
    seeds = F.array(*[F.when(F.col(f"w.w{mask[-1]}").isNotNull(), h) for mask, h in zip(MASKS, whole, strict=True)])
    return windows.select(*keys, at, F.explode(seeds).alias("seed")).where("seed is not null")


def _key(df: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, matches: int = MATCHES, min_tokens: int = MIN_TOKENS, seed_bound: int = SEED_BOUND) -> DataFrame:
    """One row (key, doc_id, item_id, doc_start, item_start, n_matches) per document and item that overlap.

    They overlap if some `window` aligned tokens (or the whole item, if shorter) have at least `matches` of
    `window` equal. The best alignment of a pair is kept. key: doc_id, or a hash of the text where that is null.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", _key(docs).alias("key"))
    items = benchmark.select("item_id", F.filter(tokens(F.col("text")), lambda x: x != "").alias("words")).where(F.size("words") >= min_tokens).distinct()
    seeds = cut(_seeds(items.select("item_id", F.transform("words", lambda x: F.xxhash64(x)).alias("t")), ["item_id"], "item_at"), "seeds")
    n_blocks = max(1, -(-seeds.count() // seed_bound))
    own = _seeds(docs.select("key", F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("t")), ["key"], "at")
    found = None
    for k in range(n_blocks):
        block = seeds if n_blocks == 1 else seeds.where(F.pmod(F.xxhash64("item_id", "seed"), F.lit(n_blocks)) == k)
        hits = own.join(F.broadcast(block), "seed").select("key", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        found = hits if found is None else found.union(hits)
    found = cut(found.distinct(), "hits")
    keys = found.select("key").distinct()
    near = F.broadcast(keys) if keys.count() <= KEY_BOUND else keys
    texts = docs.join(near, "key", "left_semi").select("key", "doc_id", tokens(F.col("text")).alias("own"))
    both = found.join(texts, "key").join(items, "item_id")
    start, begin = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("own") - start, F.size("words") - begin)
    same = F.zip_with(F.slice("own", start + 1, length), F.slice("words", begin + 1, length), lambda a, b: (a == b).cast("int"))
    both = both.select("key", "doc_id", "item_id", start.alias("doc_start"), begin.alias("item_start"), same.alias("same"), F.least(F.lit(window), F.size("words")).alias("wide"))
    total = lambda i: F.aggregate(F.slice("same", i, F.col("wide")), F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("wide") + 1), total))
    both = both.where("size(same) >= wide").withColumn("n_matches", best)
    both = both.where(F.col("n_matches") * window >= F.col("wide") * matches)
    pick = F.max(F.struct("n_matches", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b")
    out = both.groupBy("key", "doc_id", "item_id").agg(pick)
    return out.select("key", "doc_id", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), "b.n_matches")


def without_overlaps(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that overlap with no item, all columns kept."""
    key = unused("key", docs.columns)
    found = cut(overlaps(docs, benchmark, **how).select(F.col("key").alias(key)).distinct(), "leaks")
    found = F.broadcast(found) if found.count() <= KEY_BOUND else found
    return docs.withColumn(key, _key(docs)).join(found, key, "left_anti").drop(key)
