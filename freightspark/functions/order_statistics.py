"""Exact order statistics of many groups, none of which is ordered in one task.

Values are counted by group and value first, and these counts are range-partitioned by both: a group, however large, lies in
as many ranges as its values fill. Running sums over the totals of the ranges tell in which range a rank lies, and only there values are
counted through. Groups may be null; null values are left out.

Where groups are few and their values hardly repeat, counts by value are as many as the rows; narrowed_quantiles() counts by cells of
values instead and keeps only the rows of the cells that hold a wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.shared import cut

#: Cells of values to a doubling, and parts of a cell that is split.
CELLS, PARTS = 256, 4096


def placed_values(df: DataFrame, by: list[str], value: Column, sums: dict[str, Column] | None = None, weight: Column | None = None) -> DataFrame:
    """(g, value, n, part, sums...): one row a group and value; g holds the group's columns, n rows or their weight, part is the range."""
    n = F.count("*") if weight is None else F.sum(weight)
    g = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = df.select("*", g.alias("g"), value.alias("value")).where("value is not null")
    counts = rows.groupBy("g", "value").agg(n.alias("n"), *[c.alias(k) for k, c in (sums or {}).items()])
    return cut(counts.repartitionByRange("g", "value").withColumn("part", F.spark_partition_id()), "placed-values")


def _at(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, name, value): the least value up to which a group holds `need`. wanted: (g, name, need), need above 0."""
    ranges = placed.groupBy("g", "part").agg(F.sum("n").alias("n"))
    # a row for each range that a group has values in
    before = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = ranges.withColumn("before", before)
    hit = spans.join(wanted, "g").where("before < need and need <= before + n").select("g", "part", "name", "need", "before")
    hit = cut(hit, "wanted-ranks")
    inside = placed.select("g", "part", "value", "n").join(hit.select("g", "part").distinct(), ["g", "part"], "left_semi")
    upto = F.sum("n").over(W.partitionBy("g", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    found = inside.withColumn("upto", upto).join(hit, ["g", "part"]).where(F.col("before") + F.col("upto") >= F.col("need"))
    return found.groupBy("g", "name").agg(F.min("value").alias("value"))


def _columns(found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    wide = found.groupBy("g").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in names])
    return wide.select(*[F.col("g")[c].alias(c) for c in by], *names)


def _ranks(total: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(g, base, place, name, need): the two ranks, counted from 1, between which each quantile of a group of n values lies. total: (g, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(s)).alias("share")) for k, s in shares.items()]))
    place = (F.col("n") - 1) * F.col("w.share")
    ends = F.explode(F.array(F.struct(F.lit("low").alias("end"), F.floor(place).alias("rank")), F.struct(F.lit("high").alias("end"), F.ceil(place).alias("rank"))))
    wanted = total.select("g", "n", each.alias("w")).select("g", F.col("w.name").alias("base"), place.alias("place"), ends.alias("e"))
    return cut(wanted.select("g", "base", "place", F.concat_ws(" ", "base", "e.end").alias("name"), (F.col("e.rank") + 1).alias("need")), "ranks")


def _between(found: DataFrame, wanted: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The quantiles from the values (g, name, value) at the ranks of _ranks()."""
    found = found.join(wanted.drop("need"), ["g", "name"])
    low, high = (F.max(F.when(F.endswith("name", F.lit(f" {e}")), F.col("value"))) for e in ("low", "high"))
    both = found.groupBy("g", F.col("base").alias("name")).agg(low.alias("low"), high.alias("high"), F.max(F.col("place") - F.floor("place")).alias("part"))
    return _columns(both.select("g", "name", (F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part")).alias("value")), by, names)


def quantiles_of(placed: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles of each group's values, linear between the two nearest: (by..., a column a share)."""
    wanted = _ranks(placed.groupBy("g").agg(F.sum("n").alias("n")), shares)
    return _between(_at(placed, wanted.select("g", "name", "need")), wanted, by, list(shares))


def _cell(value: Column) -> Column:
    """A number that does not fall where the double rises: CELLS to a doubling of its size, of either sign; NaN comes last."""
    size = F.abs(value)
    log = F.when(size == float("inf"), F.lit(1 << 40)).otherwise(F.floor((F.log2(size) + 1075) * CELLS))
    return F.when(F.isnan(value), F.lit(1 << 41)).when(size == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * log).cast("long")


def narrowed_quantiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """As quantiles(), for groups that are few: rows are counted by group and cell, and go on only where a cell holds a wanted rank.

    df is read several times, so it should be written. Cells are split until each that is wanted holds one value: the least
    and the greatest value of a cell never share a part of it, so every round gets on.
    """
    rows = df.select(F.struct(*[F.col(c) for c in by]).alias("g"), value.cast("double").alias("value")).where("value is not null")
    # `start`, the least value of a cell, tells the cells of a group apart
    rows = rows.select("g", "value", F.lit(0.0).alias("start"), _cell(F.col("value")).alias("cell"))
    wanted = need = done = None
    while True:
        cells = cut(rows.groupBy("g", "start", "cell").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")), "cells")
        if need is None:
            wanted = _ranks(cells.groupBy("g").agg(F.sum("n").alias("n")), shares)
            need = wanted.select("g", "name", "need", F.lit(0.0).alias("start"))
        # a row a cell
        before = F.coalesce(F.sum("n").over(W.partitionBy("g", "start").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = cells.withColumn("before", before).join(need, ["g", "start"]).where("before < need and need <= before + n")
        hit = cut(hit.select("g", "start", "cell", "name", (F.col("need") - F.col("before")).alias("need"), "least", "most"), "wanted-cells")
        found = hit.where("least = most").select("g", "name", F.col("least").alias("value"))
        done = found if done is None else done.union(found)
        wide = hit.where("least < most")
        if wide.isEmpty():
            return _between(done, wanted, by, list(shares))
        inside = rows.join(F.broadcast(wide.select("g", "start", "cell", "least", "most").distinct()), ["g", "start", "cell"])
        part = F.floor((F.col("value") - F.col("least")) / (F.col("most") - F.col("least")) * PARTS)
        rows = cut(inside.select("g", "value", F.col("least").alias("start"), part.cast("long").alias("cell")), "inside")
        need = wide.select("g", "name", "need", F.col("least").alias("start"))


def quantiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """As quantiles_of, of a column of a table."""
    return quantiles_of(placed_values(df, by, value), by, shares)


def values_at(df: DataFrame, by: list[str], value: Column, ranks: dict[str, Column]) -> DataFrame:
    """(by..., a column a rank): the values at ranks from 0, given by the group's number of values `n`."""
    placed = placed_values(df, by, value)
    total = placed.groupBy("g").agg(F.sum("n").alias("n"))
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("name"), (r.cast("long") + 1).alias("need")) for k, r in ranks.items()]))
    return _columns(_at(placed, total.select("g", each)), by, list(ranks))


def least_reaching(df: DataFrame, by: list[str], value: Column, weight: Column, fraction: float, name: str) -> DataFrame:
    """(by..., name): the least value up to which a group holds the fraction of its weight; only positive weights count."""
    placed = placed_values(df.where(weight > 0), by, value, weight=weight)
    total = placed.groupBy("g").agg(F.sum("n").alias("n"))
    wanted = total.select("g", F.lit(name).alias("name"), (F.col("n") * fraction).alias("need"))
    return _columns(_at(placed, wanted), by, [name])


def values_reaching(df: DataFrame, by: list[str], value: Column, weight: Column, wanted: DataFrame) -> DataFrame:
    """(by..., name, value): the least values up to which a group holds `need` of its weight. wanted: (by..., name, need), need above 0."""
    placed = placed_values(df, by, value, weight=weight)
    found = _at(placed, wanted.select(F.struct(*[F.col(c) for c in by]).alias("g"), "name", "need"))
    return found.select(*[F.col("g")[c].alias(c) for c in by], "name", "value")
