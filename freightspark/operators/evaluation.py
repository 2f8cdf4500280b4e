"""Scoring of price proxies against realised prices: ground truth, joins, variants, metrics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.order_statistics import narrowed_quantiles, placed_values, quantiles_of, values_at
from freightspark.functions.scalars import auction_bin
from freightspark.functions.shared import cut

KEY = ["shipment_month", "actual_origin_id", "destination_region"]
#: Columns that come from the realised price itself: never features.
TARGET_COLUMNS = frozenset({"fact_rub_total", "fact_rub_per_item", "actual_price", "market_spread"})


def leakage_guard(df: DataFrame, features: list[str]) -> None:
    bad = sorted(TARGET_COLUMNS & set(features))
    if bad:
        raise ValueError(f"derived from the target: {bad}")
    if missing := sorted(set(features) - set(df.columns)):
        raise ValueError(f"no such columns: {missing}")


def snapshot_errors(df: DataFrame, tolerance: float = 0.05) -> Column:
    """Names of the rules that a snapshot row breaks, in order."""
    negative = [F.when(F.col(c) < 0, f"negative_{c}") for c in ("qty_total", "fact_rub_total", "fact_rub_per_item", "market_rub_per_item") if c in df.columns]
    usable = (F.col("qty_total") > 0) & F.col("fact_rub_total").isNotNull() & (F.col("fact_rub_per_item") > 0)
    apart = F.abs(F.col("fact_rub_total") / F.col("qty_total") - F.col("fact_rub_per_item")) / F.col("fact_rub_per_item") > tolerance
    return F.array_compact(
        F.array(
            *[F.when(F.col(c).isNull(), f"missing_{c}") for c in ("snapshot_month", "shipment_month", "actual_origin_id", "destination_region")],
            *negative,
            F.when((F.col("auction_percent") < 0) | (F.col("auction_percent") > 1), "auction_percent_scale"),
            F.when(usable & apart, "price_mismatch"),
            *[F.when(~F.col(c), "month_label_mismatch") for c in ("label_ok",) if c in df.columns],
        )
    )


#: The rules of a snapshot row.
SNAPSHOT_RULES = (
    *[f"missing_{c}" for c in ("snapshot_month", "shipment_month", "actual_origin_id", "destination_region")],
    *[f"negative_{c}" for c in ("qty_total", "fact_rub_total", "fact_rub_per_item", "market_rub_per_item")],
    "auction_percent_scale", "price_mismatch", "month_label_mismatch", "duplicate_key",
)


def marked_snapshots(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The rows with their errors; repeated natural keys are errors too."""
    key = ["snapshot_month", *KEY]
    marked = df.withColumn("errors", snapshot_errors(df, tolerance)).withColumn("_n", F.count("*").over(W.partitionBy(*key)))
    return marked.withColumn("errors", F.when(F.col("_n") > 1, F.array_append("errors", F.lit("duplicate_key"))).otherwise(F.col("errors"))).drop("_n")


def check_snapshots(df: DataFrame, mode: str = "split", tolerance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with errors). Repeated natural keys are rejected too. mode='fail' raises on any reject."""
    marked = marked_snapshots(df, tolerance)
    rejected = marked.where(F.size("errors") > 0)
    if mode == "fail" and (n := rejected.count()):
        raise ValueError(f"{n} snapshot rows break a rule")
    return marked.where(F.size("errors") == 0).drop("errors"), rejected


def as_of(snapshots: DataFrame, month: str | None = None, shipment_months: list[str] | None = None) -> DataFrame:
    out = snapshots if month is None else snapshots.where(F.col("snapshot_month") <= month)
    return out if not shipment_months else out.where(F.col("shipment_month").isin(*shipment_months))


def ground_truth(snapshots: DataFrame) -> DataFrame:
    """One row per key: the latest snapshot with a fact, else the latest; the status tells when it was taken."""
    order = F.struct(F.col("fact_rub_per_item").isNotNull().alias("f"), F.col("snapshot_month").alias("m"))
    fields = [c for c in snapshots.columns if c not in KEY]
    best = snapshots.groupBy(*KEY).agg(F.max_by(F.struct(*fields), order).alias("b"))
    out = best.select(*KEY, "b.*").withColumnRenamed("fact_rub_per_item", "actual_price").withColumnRenamed("qty_total", "qty")
    h = F.col("horizon")
    return out.withColumn("truth_status", F.when(F.col("actual_price").isNull(), "missing").when(h < 0, "final_post_shipment").when(h == 0, "m0_only").otherwise("pre_shipment_only"))


def origin_match_summary(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: origins by match status, and the shares of quantity and of cells that belong to matched origins."""
    status = F.col("match_status")
    by_origin = truth.groupBy("actual_origin_id").agg(F.sum(F.greatest(F.coalesce("qty", F.lit(0.0)), F.lit(0.0))).alias("qty"), F.count("*").alias("cells"))
    matched = mapping.where(status == "matched").select("actual_origin_id").distinct().withColumn("hit", F.lit(True))
    own = by_origin.join(matched, "actual_origin_id", "left")
    share = lambda c: F.coalesce(F.sum(F.when(F.col("hit"), F.col(c))) / F.nullif(F.sum(c), F.lit(0)), F.lit(0.0))
    cover = own.agg(share("qty").alias("matched_qty"), share("cells").alias("matched_cells"))
    counts = mapping.agg(F.count("*").alias("origins"), *[F.count_if(status == x).alias(x) for x in ("matched", "ambiguous", "unmatched")])
    return counts.crossJoin(cover)  # one row each


def revision_report(snapshots: DataFrame) -> DataFrame:
    """How much each measure moved from the first to the last snapshot of a key."""
    fields = ("fact_rub_per_item", "market_rub_per_item", "qty_total", "auction_percent")
    m = F.col("snapshot_month")
    ends = snapshots.groupBy(*KEY).agg(*[f(F.struct(c), m).alias(f"{n}_{c}") for c in fields for n, f in (("first", F.min_by), ("last", F.max_by))])
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"first_{c}.{c}").alias("a"), F.col(f"last_{c}.{c}").alias("b")) for c in fields]))
    moved = ends.select(pairs).where("a is not null and b is not null and a != 0").withColumn("r", F.abs(F.col("b") - F.col("a")) / F.abs("a"))
    over = lambda x: F.sum((F.col("r") > x).cast("long"))
    return moved.groupBy("metric").agg(F.count("*").alias("n"), over(0.01).alias("over_1"), over(0.05).alias("over_5"), F.avg((F.col("r") > 0.01).cast("double")).alias("share_1"), F.avg((F.col("r") > 0.05).cast("double")).alias("share_5"))


def market_history(snapshots: DataFrame) -> DataFrame:
    """Latest positive market price per key and horizon, as a map. A key has as many entries as horizons."""
    rows = snapshots.where("market_rub_per_item > 0").groupBy(*KEY, "horizon").agg(F.max_by("market_rub_per_item", "snapshot_month").alias("p"))
    return rows.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", "p")))).alias("market_by_horizon"))


def actual_audit(snapshots: DataFrame) -> DataFrame:
    keys = snapshots.groupBy(*KEY).agg(F.count("*").alias("v"), F.max(F.col("fact_rub_per_item").isNotNull().cast("int")).alias("f"), F.sum("qty_total").alias("q"))
    return keys.groupBy(F.col("v").alias("versions")).agg(F.count("*").alias("n_keys"), F.sum("f").alias("with_fact"), F.sum("q").alias("qty"))


def price_cells(obs: DataFrame, region: str = "continent") -> DataFrame:
    """Price aggregates per origin, region and period. The weighted rate divides by routed rows only, its numerator
    by all priced rows: an asymmetry of the feed's rules that is kept."""
    p, t, length = F.col("price"), F.greatest(F.coalesce("trip_count", F.lit(0)), F.lit(0)), F.col("route_length")
    priced = p > 0
    routed = priced & (length > 0)
    out = obs.groupBy("origin_fias", F.col(region).alias("destination_region"), "period_id").agg(
        F.avg(F.when(priced, p)).alias("pulse_price"),
        (F.sum(F.when(priced, p * t)) / F.nullif(F.sum(F.when(priced, t)), F.lit(0))).alias("pulse_trip_weighted_price"),
        (F.sum(F.when(routed, p)) / F.nullif(F.sum(F.when(routed, length)), F.lit(0.0))).alias("pulse_rub_per_km"),
        (F.sum(F.when(priced, p * t)) / F.nullif(F.sum(F.when(routed, length * t)), F.lit(0.0))).alias("pulse_weighted_rub_per_km"),
        F.array_join(F.sort_array(F.collect_set("period_type")), ",").alias("period_types"),
    )
    return out


def temporal_status(period_types: str = "period_types") -> Column:
    """What the periods of a price cell are to the realised price; `period_types` is their comma-joined set."""
    p = F.col(period_types)
    named = {"current": "contemporaneous", "retro": "retrospective_diagnostic", "forecast": "forecast_with_realized_actual"}
    known = [F.when(p == k, v) for k, v in named.items()]
    return F.coalesce(*known, F.when(F.coalesce(p, F.lit("")) == "", "missing"), F.lit("mixed_period_types"))


def matched_distance(cells: DataFrame, distances: DataFrame) -> DataFrame:
    """Distance of each (origin_fias, destination_region, shipment_month): month-exact candidates, else those without a month."""
    n = [F.count("*").alias("n"), F.first("distance_km").alias("km")]
    exact = distances.where("shipment_month is not null").groupBy("origin_fias", "destination_region", "shipment_month").agg(*[x.alias(f"e_{a}") for x, a in zip(n, ("n", "km"), strict=True)])
    loose = distances.where("shipment_month is null").groupBy("origin_fias", "destination_region").agg(*[x.alias(f"l_{a}") for x, a in zip(n, ("n", "km"), strict=True)])
    both = cells.join(exact, ["origin_fias", "destination_region", "shipment_month"], "left").join(loose, ["origin_fias", "destination_region"], "left")
    count, km = F.coalesce("e_n", "l_n", F.lit(0)), F.when(F.col("e_n").isNotNull(), F.col("e_km")).otherwise(F.col("l_km"))
    status = F.when(count == 0, "missing").when(count == 1, "matched").otherwise("ambiguous")
    return both.withColumns({"distance_status": status, "distance_km": F.when(count == 1, km)}).drop("e_n", "e_km", "l_n", "l_km")


def evaluation_dataset(truth: DataFrame, mapping: DataFrame, cells: DataFrame, distances: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """Ground truth with mapping, price cell, distance and cluster of each key, and a status for each join."""
    rows = truth.join(mapping.select("actual_origin_id", "origin_fias", "match_status"), "actual_origin_id", "left")
    rows = rows.withColumn("origin_status", F.coalesce("match_status", F.lit("unmatched"))).withColumn("origin_fias", F.when(F.col("match_status") == "matched", F.col("origin_fias"))).drop("match_status")
    rows = rows.withColumn("period_id", F.replace("shipment_month", F.lit("-"), F.lit("")))
    rows = rows.join(cells, ["origin_fias", "destination_region", "period_id"], "left")
    rows = rows.withColumns({"price_status": F.when(F.col("pulse_price").isNotNull(), "matched").otherwise("missing"), "temporal_status": temporal_status()})
    rows = matched_distance(rows, distances)
    if assignments is not None:
        rows = rows.join(assignments, KEY, "left")
        return rows.withColumn("cluster_status", F.when(F.col("cluster_id").isNotNull(), "matched").otherwise("missing"))
    none = {"cluster_id": "int", "cluster_price": "double", "cluster_rub_per_km": "double", "destination_fias": "string"}
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in none.items()}).withColumn("cluster_status", F.lit("missing"))


def coverage_report(rows: DataFrame) -> DataFrame:
    """Share of cells and of quantity that each join reaches."""
    q = F.greatest(F.coalesce("qty", F.lit(0.0)), F.lit(0.0))
    tests = {"truth": F.col("actual_price").isNotNull(), "origin": F.col("origin_fias").isNotNull(), "price": F.col("pulse_price").isNotNull(), "distance": F.col("distance_status") == "matched", "cluster": F.col("cluster_id").isNotNull()}
    share = lambda x: [F.avg(x.cast("double")), F.sum(F.when(x, q).otherwise(0.0)) / F.nullif(F.sum(q), F.lit(0.0))]
    return rows.agg(F.count("*").alias("cells"), *[c.alias(f"{n}_{k}") for n, x in tests.items() for k, c in zip(("cells", "qty"), share(x), strict=True)])




def variant_columns(horizon: int | None = None) -> dict[str, Column]:
    c = F.col
    placed = c("destination_fias").isNotNull() & c("cluster_id").isNotNull()
    market = c("market_rub_per_item") if horizon is None else F.element_at("market_by_horizon", F.lit(horizon))
    return {
        "E0": c("pulse_price"),
        "E0_trip_weighted": c("pulse_trip_weighted_price"),
        "E1": c("pulse_rub_per_km") * c("distance_km"),
        "E2": F.when(placed, c("cluster_price")),
        "E3": F.when(placed, c("cluster_rub_per_km") * c("distance_km")),
        "ATI_REF": market,
    }


def predictions(rows: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """Long form: a row per key and variant, with what metrics and segments need."""
    columns = columns or variant_columns()
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), v.cast("double").alias("predicted")) for n, v in columns.items()]))
    return rows.select(*KEY, "actual_price", "qty", "horizon", "auction_percent", each)


def comparable(p: DataFrame) -> DataFrame:
    finite = F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.abs("predicted") < float("inf"))
    return p.where((F.col("actual_price") > 0) & (F.col("qty") > 0) & finite)


def metrics(p: DataFrame, by: list[str]) -> DataFrame:
    """Weighted error metrics per group over comparable rows: one pass adds up by group and relative error, the median is counted out of that."""
    q, a, e = F.col("qty"), F.col("actual_price"), F.col("predicted") - F.col("actual_price")
    ape = 100 * F.abs(e) / a
    sums = {"qty": F.sum(q), "error": F.sum(q * F.abs(e)), "bias": F.sum(q * e), "value": F.sum(q * a)}
    placed = placed_values(comparable(p), by, ape, {f"sum_{k}": c for k, c in sums.items()})
    add = {k: F.sum(f"sum_{k}") for k in sums}
    within = lambda x: 100 * F.sum(F.when(F.col("value") <= x, F.col("sum_qty")).otherwise(0.0)) / add["qty"]
    whole = placed.groupBy("g").agg(
        F.sum("n").alias("cells"),
        add["qty"].alias("qty"),
        (100 * add["error"] / add["value"]).alias("wape_pct"),
        (add["error"] / add["qty"]).alias("weighted_mae"),
        (100 * add["bias"] / add["value"]).alias("bias_pct"),
        within(10).alias("within_10_pct"),
        within(20).alias("within_20_pct"),
    )
    middle = quantiles_of(placed, by, {"mdape_pct": 0.5}).select(F.struct(*by).alias("g"), "mdape_pct")
    out = whole.join(middle, "g")
    return out.select(*[F.col("g")[c].alias(c) for c in by], "cells", "qty", "wape_pct", "weighted_mae", "mdape_pct", "bias_pct", "within_10_pct", "within_20_pct")


def coverage(p: DataFrame) -> DataFrame:
    """Share of quantity that each variant predicts; a variant without any prediction is blocked."""
    q = F.greatest(F.coalesce("qty", F.lit(0.0)), F.lit(0.0))
    has = F.col("predicted").isNotNull()
    return p.groupBy("variant").agg(F.sum(has.cast("long")).alias("predicted_cells"), F.coalesce(F.sum(F.when(has, q)) / F.nullif(F.sum(q), F.lit(0.0)), F.lit(0.0)).alias("coverage"), F.when(F.max(has), "evaluated").otherwise("blocked").alias("status"))


def quartile_thresholds(p: DataFrame) -> DataFrame:
    """Quantities at places n/4, n/2 and 3n/4 (counted from 0) of the ascending quantities of the keys; no row without keys."""
    keys = p.select(*KEY, F.coalesce("qty", F.lit(0.0)).alias("q")).distinct()
    return values_at(keys, [], F.col("q"), {f"t{i}": F.floor(F.col("n") * i / 4) for i in (1, 2, 3)})


def segment_metrics(p: DataFrame) -> DataFrame:
    """Metrics by month, origin, region, horizon, volume quartile and auction share: rows are labelled once per dimension."""
    t = quartile_thresholds(p)
    q = F.coalesce("qty", F.lit(0.0))
    quartile = F.when(q <= F.col("t1"), "Q1").when(q <= F.col("t2"), "Q2").when(q <= F.col("t3"), "Q3").otherwise("Q4")
    horizon = F.coalesce(F.concat(F.lit("M"), F.col("horizon").cast("string")), F.lit("missing"))
    labels = {"shipment_month": F.col("shipment_month"), "origin": F.col("actual_origin_id"), "destination_region": F.col("destination_region"), "target_horizon": horizon, "volume_quantile": quartile, "auction_percent_posthoc": auction_bin(F.col("auction_percent"))}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), x.alias("label")) for d, x in labels.items()]))
    return metrics(p.crossJoin(F.broadcast(t)).withColumn("s", each).select("*", "s.dimension", "s.label"), ["variant", "dimension", "label"])


def common_keys(p: DataFrame, variants: list[str]) -> DataFrame:
    """Keys that every listed variant predicts."""
    have = p.where(F.col("variant").isin(*variants) & F.col("predicted").isNotNull())
    return have.groupBy(*KEY).agg(F.countDistinct("variant").alias("n")).where(F.col("n") == len(set(variants))).drop("n")


def leaderboard(p: DataFrame, base: str = "E0") -> DataFrame:
    """Each variant over all it predicts, and over the keys it shares with the base; gain is the relative fall in WAPE."""
    alone = metrics(p, ["variant"]).withColumn("scope", F.lit("all_available"))
    own = p.where((F.col("variant") == base) & F.col("predicted").isNotNull()).select(*KEY, F.col("predicted").alias("base_predicted"))
    both = p.where(F.col("predicted").isNotNull()).join(own, KEY)
    shared = metrics(both, ["variant"]).withColumn("scope", F.lit("common_with_base"))
    of_base = metrics(both.withColumn("predicted", F.col("base_predicted")), ["variant"]).select("variant", F.col("wape_pct").alias("base_wape"))
    gain = F.when(F.col("base_wape") > 0, 100 * (F.col("base_wape") - F.col("wape_pct")) / F.col("base_wape"))
    shared = shared.join(of_base, "variant").withColumn("gain_pct", gain).drop("base_wape")
    return alone.withColumn("gain_pct", F.lit(None).cast("double")).unionByName(shared)


def by_horizon(rows: DataFrame) -> DataFrame:
    """Metrics of the market reference at each horizon of its history."""
    long = rows.select(*KEY, "actual_price", "qty", F.explode("market_by_horizon").alias("h", "predicted"))
    return metrics(long, ["h"])


def _poisson_steps() -> list[float]:
    """Cumulative probabilities of a Poisson(1) draw of 0 to 7."""
    steps, term, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    return steps


POISSON_STEPS = tuple(_poisson_steps())


def paired_bootstrap(p: DataFrame, variant: str, base: str = "E0", iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Difference of WAPE over keys that both predict, and the resampled 2.5 and 97.5 per cent order statistics.

    Each key's weight in an iteration is a Poisson(1) draw from a digest of key and iteration, so the resample needs
    no shuffle of keys; sums are combined map-side.
    """
    ok = comparable(p)
    a = ok.where(F.col("variant") == variant).select(*KEY, "actual_price", "qty", F.col("predicted").alias("pa"))
    pair = a.join(ok.where(F.col("variant") == base).select(*KEY, F.col("predicted").alias("pb")), KEY)
    # few rows that become many: dealt out first. Iteration -1 is the sample as it is
    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    it = pair.repartition(n, *KEY).select("*", F.explode(F.sequence(F.lit(-1), F.lit(iterations - 1))).alias("i"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("i").cast("string"), *KEY))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    w = F.when(F.col("i") < 0, 1).otherwise(sum((u > c).cast("int") for c in POISSON_STEPS))
    q = F.col("qty") * w
    error = lambda c: F.sum(q * F.abs(F.col(c) - F.col("actual_price")))
    sums = it.groupBy("i").agg(F.count("*").alias("pairs"), error("pa").alias("ea"), error("pb").alias("eb"), F.sum(q * F.col("actual_price")).alias("t"))
    d = sums.where("t > 0").select("i", "pairs", (100 * (F.col("ea") - F.col("eb")) / F.col("t")).alias("delta"))
    drawn = F.col("i") >= 0
    at = lambda x: F.get("deltas", F.floor(x * (F.size("deltas") - 1)).cast("int"))
    # one number an iteration
    out = d.agg(F.max("pairs").alias("pairs"), F.count_if(drawn).alias("iterations"), F.max(F.when(~drawn, F.col("delta"))).alias("delta_wape_pct"), F.array_sort(F.collect_list(F.when(drawn, F.col("delta")))).alias("deltas"))
    return out.select(F.coalesce("pairs", F.lit(0)).alias("pairs"), "iterations", "delta_wape_pct", at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))


def success_gate(p: DataFrame, variant: str, base: str = "E0") -> DataFrame:
    """Gain of at least 5 %, no more than one point of extra bias, better in at least half of the months (and two)."""
    own = p.where((F.col("variant") == base) & F.col("predicted").isNotNull()).select(*KEY, F.col("predicted").alias("b"))
    both = comparable(p.where(F.col("variant") == variant).join(own, KEY)).where("b is not null")
    pair = both.select(*KEY, "actual_price", "qty", F.inline(F.array(F.struct(F.lit("v").alias("w"), F.col("predicted")), F.struct(F.lit("b").alias("w"), F.col("b").alias("predicted")))))
    whole = metrics(pair, ["w"]).groupBy().pivot("w", ["v", "b"]).agg(F.first("wape_pct").alias("wape"), F.first("bias_pct").alias("bias"))
    month = metrics(pair, ["shipment_month", "w"]).groupBy("shipment_month").pivot("w", ["v", "b"]).agg(F.first("wape_pct"))
    months = month.agg(F.count("*").alias("months"), F.coalesce(F.sum((F.col("v") < F.col("b")).cast("long")), F.lit(0)).alias("improved"))
    gain = F.when(F.col("b_wape") > 0, 100 * (F.col("b_wape") - F.col("v_wape")) / F.col("b_wape"))
    passed = (gain >= 5) & (F.abs("v_bias") <= F.abs("b_bias") + 1) & (F.col("improved") >= F.greatest(F.lit(2), F.ceil(F.col("months") / 2)))
    return whole.crossJoin(months).select(gain.alias("gain_pct"), "v_bias", "b_bias", "months", "improved", F.coalesce(passed, F.lit(False)).alias("passed"))


def decision_gate(report: DataFrame) -> DataFrame:
    """Readiness from the coverage report: truth and origin 0.9, distance and cluster 0.8."""
    return report.select(((F.col("truth_qty") >= 0.9) & (F.col("origin_qty") >= 0.9)).alias("ready"), (F.col("distance_qty") >= 0.8).alias("distance_ready"), (F.col("cluster_qty") >= 0.8).alias("cluster_ready"))


def rate_train_test(obs: DataFrame, assignments: DataFrame, train: list[str], test: list[str]) -> DataFrame:
    """Regional against per-cluster rates from the train periods, as prices on the test periods: overall and by period (rollup)."""
    if set(train) & set(test):
        raise ValueError("train and test periods overlap")
    ok = obs.where("price > 0 and route_length > 0").join(assignments, ["destination_region", "destination_fias"], "left")
    w = F.greatest(F.coalesce("trip_count", F.lit(0)), F.lit(1))
    rate = (F.sum(F.col("price") * w) / F.sum(F.col("route_length") * w)).alias("rate")
    fit, held = ok.where(F.col("period_id").isin(*train)), ok.where(F.col("period_id").isin(*test))
    regional = fit.groupBy("destination_region").agg(rate.alias("regional_rate"))
    own = fit.where("cluster_id is not null").groupBy("destination_region", "cluster_id").agg(rate.alias("cluster_rate"))
    rows = held.join(regional, "destination_region", "left").join(own, ["destination_region", "cluster_id"], "left").withColumn("w", w)
    known = F.col("cluster_rate").isNotNull() & F.col("regional_rate").isNotNull()
    err = lambda c: F.sum(F.when(known, F.col("w") * F.abs(F.col(c) * F.col("route_length") - F.col("price"))))
    total = F.sum(F.when(known, F.col("w") * F.col("price")))
    out = rows.rollup("period_id").agg(F.count("*").alias("n_rows"), F.sum((~known).cast("long")).alias("unmatched"), (100 * err("regional_rate") / total).alias("regional_wape"), (100 * err("cluster_rate") / total).alias("cluster_wape"))
    return out.withColumn("gain_pct", F.when(F.col("regional_wape") > 0, 100 * (F.col("regional_wape") - F.col("cluster_wape")) / F.col("regional_wape")))


def distance_hypothesis(rows: DataFrame) -> DataFrame:
    """Three price variants of trips against their price: rate of the cell of origin, region and period, mean rate, mean price of the cells.

    rows: origin_fias, destination_region, period_id, price, route_length, trip_count, and whether a row counts for its cell (`market`)
    and whether it is a trip (`trip`). Rows meet the rate of their cell in one shuffle, by cell, and are written once.
    """
    p, length = F.col("price"), F.col("route_length")
    cell = W.partitionBy("origin_fias", "destination_region", "period_id").orderBy("period_id")
    all_of = cell.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    priced = F.col("market") & (p > 0)
    routed = priced & (length > 0)
    held = rows.select(
        "price", "route_length", "trip_count", "trip",
        (F.row_number().over(cell) == 1).alias("first"),
        F.sum(F.when(routed, p)).over(all_of).alias("priced_sum"),
        F.sum(F.when(routed, length)).over(all_of).alias("length_sum"),
        F.avg(F.when(priced, p)).over(all_of).alias("cell_price"),
    )
    held = held.withColumn("rate", F.col("priced_sum") / F.nullif("length_sum", F.lit(0.0)))
    held = cut(held.select("price", "route_length", "trip_count", "trip", "first", "rate", F.when(F.col("first"), F.col("cell_price")).alias("cell_price")), "trips")
    means = cut(held.where("first").agg(F.avg("rate").alias("mean_rate"), F.avg("cell_price").alias("mean_price")), "cell-means")
    each = {"cell_rate": F.col("rate") * length, "mean_rate": F.col("mean_rate") * length, "mean_price": F.col("mean_price")}
    trips = held.where("trip").crossJoin(F.broadcast(means))  # one row
    long = trips.select("price", "trip_count", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("predicted")) for n, c in each.items()])))
    t, e = F.col("trip_count"), F.abs(F.col("predicted") - p)
    good = (p > 0) & (t > 0) & F.col("predicted").isNotNull()  # null, and not counted, where that depends on a null
    add = lambda c: F.sum(F.when(good, c))
    whole = long.groupBy("variant").agg(F.avg(good.cast("double")).alias("coverage"), (100 * add(t * e) / add(t * p)).alias("wape_pct"))
    middle = narrowed_quantiles(long.where(good), ["variant"], 100 * e / p, {"mdape_pct": 0.5})
    return whole.join(middle, "variant", "left").select("variant", "coverage", "wape_pct", "mdape_pct")
