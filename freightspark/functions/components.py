"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations and joins over the edge table, which is written to the shared folder
so that a lost executor costs at most one round. No vertex's neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.functions.shared import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of the edges: equal before and after a round once the components are stars."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """Label every vertex that has an edge with the least vertex of its component: (node, component).

    Vertices may be longs, strings or structs (anything that orders). Self loops and repeated edges are
    harmless; null ends are dropped; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select("u").distinct()
    e = cut(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        e = cut(_small_star(_large_star(e)), "cc", replaces=e)
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("component").alias("node"), F.col("component")).distinct()
    known = star.union(roots)
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(known, "node", "left_anti")
    return known.union(alone)
