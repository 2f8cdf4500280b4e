"""Mixing sources to target weights: Efraimidis-Spirakis keys within a source, summed up to a budget of words.

A source's target is its weighted share of all words, at most EPOCHS times its own words; what is beyond that goes to the other
sources by weight. The mix takes every document of a source as often as the target holds the whole source, and for the rest of the
target documents in the order of -ln(u) / quality, u a digest of id and text: a weighted sample without replacement.

No source is ordered as a whole. Its keys are counted in CELLS cells, equal in 1 - 1 / (1 + key), which holds keys of any size apart; running
sums over the cells show in which of them the budget ends, and only that one is looked at more closely: by cells again, by keys, and last,
since rows with equal keys are copies of each other, by how many of them are taken. A document belongs to the mix if its middle word is
within the budget, so the words taken differ from the target by at most half a document.

Defined cases: a null text has no words, and documents without words are never taken; a null source is a source of its own, the
last in order; a null id takes part under a digest of its text; of rows with equal id, source and text as many are taken as fit, whichever; a null,
negative or non-finite quality counts as LEAST_QUALITY; without any words all targets are 0; an empty table gives an empty result.
Columns of any name are read from `documents` by name; others are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.shared import cut

WEIGHTS, EPOCHS = (1.0, 2.0, 3.0), 3
LEAST_QUALITY = 0.05
#: Cells that keys are counted in, and how often the cell at the budget's end is split again.
CELLS, LEVELS = 1024, 3
#: Sources whose targets may be broadcast (some tens of bytes each); beyond, they are joined by a shuffle.
SOURCE_BOUND = 100_000
#: A budget of words is rounded to this, so that a target that is a multiple of the source leaves no rest.
GRAIN = 1e-6


def n_words(text: str = "text") -> Column:
    """Number of runs of characters that are not ASCII white space."""
    space, other = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    marks = F.length(F.regexp_replace(text, f"{space}*+{other}++{space}*+", "x"))
    return F.coalesce(F.when(F.col(text).rlike(other), marks), F.lit(0)).cast("long")


def letter_share(text: str = "text") -> Column:
    """Quality of a text: the share of its characters that are letters, and LEAST_QUALITY on top."""
    return LEAST_QUALITY + F.length(F.regexp_replace(text, r"\P{L}++", "")) / F.nullif(F.length(text), F.lit(0))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds `rank`, from 0, by code point and null last: places within ranges of sources, and the ranges' counts before."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = cut(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftrightunsigned("at", 33).alias("part")
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    ranked = placed.withColumn("part", part).join(before, "part")
    return ranked.select(*sizes.columns, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds `target` to (source, source_size): its weighted share of all, at most `epochs` times its size, what is beyond shared again."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked_sources(sizes).withColumn("weight", weight), "source-weights")
    full = epochs * F.col("source_size")
    level, n_capped = 0.0, -1
    while True:
        # all sources that the level of words per weight would fill beyond their limit give the rest to the others
        capped = F.col("weight") * level > full
        words, held, open_weight, n = sources.agg(F.sum("source_size"), F.sum(F.when(capped, full)), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if n == n_capped or not words or not open_weight:
            break
        level, n_capped = float(words - (held or 0)) / open_weight, n
    return sources.select("source", "source_size", F.least(F.col("weight") * level, full.cast("double")).alias("target"))


def _digits(levels: int = LEVELS) -> list[Column]:
    """The first digits of a key's place from 0 to 1, to base CELLS; every step of it keeps the order of the keys."""
    whole = F.least(F.floor((1 - 1 / (1 + F.col("key"))) * float(CELLS**levels)), F.lit(CELLS**levels - 1))
    return [(F.floor(whole / float(CELLS ** (levels - k - 1))) % CELLS).alias(f"d{k}") for k in range(levels)]


def _running(sums: DataFrame, order: str) -> DataFrame:
    """Adds `before`, what the rows of a source before this one hold together."""
    w = W.partitionBy("source").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SOURCE_BOUND else df


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which `source` may be null."""
    other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return left.join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]), how)


def mix(docs: DataFrame, quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    own = docs.select("doc_id", "source", "text", n_words().alias("size"), (F.lit(1.0) if quality is None else quality).cast("double").alias("q"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    q = F.when((F.col("q") >= LEAST_QUALITY) & (F.col("q") < float("inf")), F.col("q")).otherwise(LEAST_QUALITY)
    keyed = own.select("doc_id", "source", "size", digest.alias("digest"), (-F.log(u) / q).alias("key"))
    keyed = cut(keyed.withColumn("at", F.monotonically_increasing_id()), "mix-keys")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = cut(targets(sizes, weights, epochs), "targets")
    whole = F.least(F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) + GRAIN), F.lit(epochs))
    plan = wanted.select("source", "source_size", "target", F.coalesce(whole, F.lit(0)).alias("epochs"))
    plan = cut(plan.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))), "plan")

    digits = [f"d{k}" for k in range(LEVELS)]
    budget, found = plan.select("source", "rest"), None
    cells = keyed.where("size > 0").select("source", "size", "key", "digest", "at", *_digits())
    path: list[str] = []
    for d in digits:
        # the cell of each source in which its budget ends, within the cell of the level before
        inside = cells if found is None else _on(cells, _small(found), ["source", *path], "left_semi")
        sums = inside.groupBy("source", *path, d).agg(F.sum("size").alias("words"))
        spans = _on(_running(sums, d), budget, ["source"], "inner").select("source", *path, d, "words", "before", F.col("r_rest").alias("rest"))
        path.append(d)
        found = cut(spans.where("before <= rest and rest < before + words").select("source", *path, (F.col("rest") - F.col("before")).alias("rest")), f"cell-{d}")
        budget = found.select("source", "rest")
    inside = _on(cells, _small(found), ["source", *path], "left_semi")
    sums = inside.groupBy("source", "key", "digest").agg(F.sum("size").alias("words"), F.max("size").alias("size"), F.count("*").alias("n"))
    spans = _on(_running(sums.withColumn("order", F.struct("key", "digest")), "order"), budget, ["source"], "inner")
    # of n copies, those whose middle word is within the budget
    copies = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("r_rest") - F.col("before")) / F.col("size") + 0.5)))
    ends = cut(spans.select("source", "key", "digest", "n", copies.alias("copies")), "ends")

    at_end = _on(inside, ends.where("0 < copies and copies < n"), ["source", "digest"], "inner").select("source", "digest", "at", F.col("r_copies").alias("copies"))
    part = F.shiftrightunsigned("at", 33)
    counts = at_end.groupBy("source", "digest", part.alias("part")).agg(F.count("*").alias("words"))
    w = W.partitionBy("source", "digest").orderBy("part")
    before = counts.select("source", "digest", "part", (F.sum("words").over(w) - F.col("words")).alias("before"))
    placed = _on(at_end.withColumn("part", part), before, ["source", "digest", "part"], "inner")
    nth = F.col("r_before") + F.row_number().over(W.partitionBy("source", "digest", "part").orderBy("at"))
    some = placed.select("at", "copies", nth.alias("nth")).where("nth <= copies").select("at")
    every = _on(inside, ends.where("copies = n"), ["source", "digest"], "left_semi").select("at")
    chosen = cut(some.union(every).select(F.col("at").alias("chosen_at")), "chosen")

    # cells before the budget's end are taken whole; a source whose budget ends nowhere has none left to take from
    known = _on(plan, found, ["source"], "left").select("source", "source_size", "target", "epochs", "rest", *[F.col(f"r_{d}").alias(f"end_{d}") for d in digits])
    known = F.broadcast(known) if known.count() <= SOURCE_BOUND else known
    out = _on(keyed.select("*", *_digits()), known, ["source"], "inner")
    out = out.join(_small(chosen), F.col("at") == F.col("chosen_at"), "left")
    ahead = F.struct(*digits) < F.struct(*[F.col(f"r_end_{d}").alias(d) for d in digits])
    once = F.when(F.coalesce(ahead, F.lit(False)) | F.col("chosen_at").isNotNull(), 1).otherwise(0)
    return out.select("doc_id", "source", "size", F.col("r_source_size").alias("source_size"), F.col("r_target").alias("target"), (F.col("size") * (F.col("r_epochs") + once)).alias("taken"))
