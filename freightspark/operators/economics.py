"""Trip-weighted economics of destinations and towns: each metric with its own denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from freightspark.functions.scalars import rub_per_km

MISSING = "<missing>"


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of v * w over sum of w, over rows with a value and a positive weight; null if there are none."""
    ok = value.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight)), F.lit(0))


def modal(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group (ties: the least); two map-side combined aggregates, no group is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))["v"].alias(name))


def slice_filter(obs: DataFrame, origins: list[str] | None = None, region: str | None = None, **choices: list[str]) -> DataFrame:
    """Exact region and origins, and multi-selects whose empty list means no restriction."""
    out = obs
    if origins is not None:
        out = out.where(F.col("origin_fias").isin(*origins))
    if region is not None:
        out = out.where(F.col("destination_region") == region)
    unknown = set(choices) - {"period_type", "price_type", "vehicle_type", "tonnage_id", "period_id"}
    if unknown:
        raise ValueError(f"no such selection: {sorted(unknown)}")
    if not set(choices.get("period_type") or ()) <= {"retro", "current", "forecast"}:
        raise ValueError("period_type must be of retro, current, forecast")
    for name, values in choices.items():
        if values:
            out = out.where(F.col(name).isin(*values))
    return out


def metric_aggregates() -> list[Column]:
    """The measures of a group of observations: rows, trips, three weighted means and their own denominators."""
    t, p, length = F.col("trip_count"), F.col("price"), F.col("route_length")
    rate = rub_per_km(p, length)
    weight = lambda ok: F.coalesce(F.sum(F.when(ok & (t > 0), t)), F.lit(0))
    return [
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(F.when(t > 0, t)), F.lit(0)).alias("trip_count"),
        weighted_mean(F.when(length > 0, length), t).alias("weighted_route_length"),
        weighted_mean(F.when(p > 0, p), t).alias("weighted_price"),
        weighted_mean(rate, t).alias("weighted_rub_per_km"),
        weight(length > 0).alias("length_trips"),
        weight(p > 0).alias("price_trips"),
        weight(rate.isNotNull()).alias("rate_trips"),
    ]


def destination_economics(obs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group and destination; rows without a destination id are left out (count them with data quality).

    One hash aggregate with partial sums; the lists hold distinct values of small domains and periods.
    """
    own = [*keys, "destination_fias"]
    known = obs.where(F.col("destination_fias").isNotNull())
    sets = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}s") for c in ("period_type", "price_type", "vehicle_type", "tonnage_id")]
    return known.groupBy(*own).agg(
        *metric_aggregates(),
        F.size(F.collect_set("period_id")).cast("long").alias("n_periods"),
        *sets,
        F.max((F.col("period_type") == "forecast").cast("int")).alias("has_forecast"),
        # the most frequent name (ties: the least); a destination has few
        F.coalesce(F.mode("destination_name", True), F.lit(MISSING)).alias("destination_name"),
    )


def destination_measures(obs: DataFrame, keys: list[str]) -> DataFrame:
    """As destination_economics, without the lists and the forecast mark.

    Rows are added up by destination and name first, in plain hash aggregates of sums; a mode over all rows would sort them.
    """
    own = [*keys, "destination_fias"]
    t, p, length = F.col("trip_count"), F.col("price"), F.col("route_length")
    means = {"length": ("weighted_route_length", F.when(length > 0, length)), "price": ("weighted_price", F.when(p > 0, p)), "rate": ("weighted_rub_per_km", rub_per_km(p, length))}
    sums = [F.count("*").alias("n_rows"), F.sum(F.when(t > 0, t)).alias("trip_count")]
    for k, (_, v) in means.items():
        ok = v.isNotNull() & (t > 0)
        sums += [F.sum(F.when(ok, v * t)).alias(f"{k}_sum"), F.sum(F.when(ok, t)).alias(f"{k}_trips")]
    named = obs.where(F.col("destination_fias").isNotNull()).groupBy(*own, "destination_name").agg(*sums)
    # the most frequent name (ties: the least)
    name = F.min(F.when(F.col("destination_name").isNotNull(), F.struct((-F.col("n_rows")).alias("n"), F.col("destination_name").alias("name"))))["name"]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return named.groupBy(*own).agg(
        total("n_rows"), total("trip_count"),
        *[(F.sum(f"{k}_sum") / F.nullif(F.sum(f"{k}_trips"), F.lit(0))).alias(name_) for k, (name_, _) in means.items()],
        *[total(f"{k}_trips") for k in means],
        F.coalesce(name, F.lit(MISSING)).alias("destination_name"),
    )


def rate_baseline(obs: DataFrame) -> DataFrame:
    """Overall, by period, by origin and by destination in one pass over GROUPING SETS."""
    p, length, t = F.col("price"), F.col("route_length"), F.col("trip_count")
    ok = (p > 0) & (length > 0)
    rows = obs.select(
        F.coalesce("period_id", F.lit(MISSING)).alias("period_id"),
        F.coalesce("origin_fias", F.lit(MISSING)).alias("origin_fias"),
        F.coalesce("destination_fias", F.lit(MISSING)).alias("destination_fias"),
        "price", "route_length", "trip_count",
    ).where(ok)
    sets = [[], [F.col("period_id")], [F.col("origin_fias")], [F.col("destination_fias")]]
    w = F.when(t > 0, t)
    return rows.groupingSets(sets, "period_id", "origin_fias", "destination_fias").agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(w), F.lit(0)).alias("trips"),
        (F.sum("price") / F.sum("route_length")).alias("rate"),
        (F.sum(p * w) / F.nullif(F.sum(length * w), F.lit(0.0))).alias("weighted_rate"),
        F.avg("price").alias("mean_price"),
        F.avg("route_length").alias("mean_length"),
    )


def weighted_abs_deviation(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean distance from the group's own weighted mean: two aggregates and a join on the group keys."""
    centre = df.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias("centre"))
    return df.join(centre, keys).groupBy(*keys).agg(weighted_mean(F.abs(F.col(value) - F.col("centre")), F.col(weight)).alias("abs_deviation"), F.first("centre").alias("centre"))


def paired_rate(price: Column, length: Column) -> Column:
    ok = (price > 0) & (length > 0)
    return F.coalesce(F.sum(F.when(ok, price)) / F.sum(F.when(ok, length)), F.lit(0.0))


PERIODS, PRICES = ("retro", "current", "forecast"), ("spot", "tender")


def _top(counts: Column, region: str, n: int = 5) -> Column:
    """The n most frequent regions of counts (an array of structs with n) as text "region:count" (ties: by name)."""
    own = F.filter(counts, lambda c: c[region].isNotNull())
    total = lambda r: F.aggregate(F.filter(own, lambda c: c[region] == r), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    ranked = F.array_sort(F.transform(F.array_distinct(F.transform(own, lambda c: c[region])), lambda r: F.struct((-total(r)).alias("n"), r.alias("r"))))
    return F.array_join(F.transform(F.slice(ranked, 1, n), lambda x: F.concat_ws(":", x["r"], (-x["n"]).cast("string"))), ",")


def _modal_of(counts: Column, name: str) -> Column:
    """The most frequent value among counts (ties: the least)."""
    values = F.array_distinct(F.transform(counts, lambda c: c[name]))
    total = lambda v: F.aggregate(F.filter(counts, lambda c: c[name] == v), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    return F.array_min(F.transform(values, lambda v: F.struct((-total(v)).alias("n"), v.alias("v"))))["v"]


#: What a town's rows are counted by.
COUNTED = ("origin_region", "destination_region", "confidence")


def direction_dashboard(obs: DataFrame, side: str = "origin", period_types: list[str] | None = None, price_types: list[str] | None = None) -> DataFrame:
    """Everything that the dashboard shows of each town of one side (name and region), after its filters.

    Prices and lengths average over positive values, with 0 for none; splits by period and price type have their own counts, averages and
    paired rate; the five most frequent regions of either end; the modal confidence, "—" for none.
    """
    if side not in ("origin", "destination"):
        raise ValueError(f"no side {side}")
    rows = slice_filter(obs, None, None, period_type=period_types or [], price_type=price_types or [])
    towns = rows.select(F.col(f"{side}_name").alias("town"), F.col(f"{side}_region").alias("region"), "origin_region", "destination_region", "price", "route_length", "trip_count", "period_type", "price_type", "confidence")
    keys = ["town", "region"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    splits = {"": F.lit(True), **{f"_{v}": F.col(kind) == v for kind, values in (("period_type", PERIODS), ("price_type", PRICES)) for v in values}}
    p, length = F.col("price"), F.col("route_length")
    paired = (p > 0) & (length > 0)
    sums = {"bids": F.sum("trip_count"), "n_bids": F.count("trip_count")}
    for v, own in splits.items():
        sums[f"n_rows{v}"] = F.count_if(own)
        sums |= {f"{k}{c}{v}": f(F.when(own & (F.col(c) > 0), F.col(c))) for c in ("price", "route_length") for k, f in (("sum_", F.sum), ("n_", F.count))}
        sums |= {f"paired_{c}{v}": F.sum(F.when(own & paired, F.col(c))) for c in ("price", "route_length")}
    ends = {f"{k}_{c}": (f, F.when(F.col(c) > 0, F.col(c))) for c in ("price", "route_length") for k, f in (("min", F.min), ("max", F.max))}
    # all rows of a town meet once; they are added up by regions and confidence first, then by town
    cells = towns.repartition(*keys).groupBy(*keys, *COUNTED).agg(
        F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()], *[f(c).alias(k) for k, (f, c) in ends.items()], *[F.collect_set(c).alias(f"{c}s") for c in ("period_type", "price_type")]
    )
    # at most one count for each pair of regions and confidence
    whole = cells.groupBy(*keys).agg(
        F.collect_list(F.struct(*COUNTED, "n")).alias("counts"), *[F.sum(k).alias(k) for k in sums], *[f(k).alias(k) for k, (f, _) in ends.items()],
        *[F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{c}s")))), ",").alias(f"{c}s") for c in ("period_type", "price_type")],
    )
    mean = lambda c, v: zero(F.col(f"sum_{c}{v}") / F.nullif(F.col(f"n_{c}{v}"), F.lit(0)))
    rate = lambda v: zero(F.col(f"paired_price{v}") / F.nullif(F.col(f"paired_route_length{v}"), F.lit(0.0)))

    def split(value: str, rated: bool) -> list[Column]:
        v = f"_{value}"
        out = [F.col(f"n_rows{v}").alias(f"n{v}"), mean("price", v).alias(f"avg_price{v}"), mean("route_length", v).alias(f"avg_length{v}")]
        return [*out, rate(v).alias(f"rate{v}")] if rated else out

    stated = F.filter("counts", lambda c: c["confidence"].isNotNull() & (c["confidence"] != "—"))
    return whole.select(
        *keys, "n_rows", mean("price", "").alias("avg_price"), zero(F.col("min_price")).alias("min_price"), zero(F.col("max_price")).alias("max_price"),
        mean("route_length", "").alias("avg_length"), zero(F.col("min_route_length")).alias("min_length"), zero(F.col("max_route_length")).alias("max_length"),
        zero(F.col("bids") / F.nullif(F.col("n_bids"), F.lit(0))).alias("avg_bids"), rate("").alias("rate"), "period_types", "price_types",
        *[c for v in PERIODS for c in split(v, True)], *[c for v in PRICES for c in split(v, False)],
        _top(F.col("counts"), "origin_region").alias("top_origin_regions"), _top(F.col("counts"), "destination_region").alias("top_destination_regions"),
        F.coalesce(_modal_of(stated, "confidence"), F.lit("—")).alias("confidence"),
    )


def town_dashboard(obs: DataFrame) -> DataFrame:
    """Per town (name, region): counts, positive-only averages with 0 for none, the paired rate, splits and the top regions."""
    towns = obs.select(F.col("destination_name").alias("town"), F.col("destination_region").alias("region"), "origin_region", "price", "route_length", "trip_count", "period_type", "price_type")
    p, length = F.when(F.col("price") > 0, F.col("price")), F.when(F.col("route_length") > 0, F.col("route_length"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    splits = [paired_rate(F.when(F.col(c) == v, F.col("price")), F.when(F.col(c) == v, F.col("route_length"))).alias(f"rate_{v}") for c, values in (("period_type", ("retro", "current", "forecast")), ("price_type", ("spot", "tender"))) for v in values]
    base = towns.groupBy("town", "region").agg(
        F.count("*").alias("n_rows"),
        zero(F.avg(p)).alias("avg_price"), zero(F.min(p)).alias("min_price"), zero(F.max(p)).alias("max_price"),
        zero(F.avg(length)).alias("avg_length"),
        zero(F.avg("trip_count")).alias("avg_bids"),
        paired_rate(F.col("price"), F.col("route_length")).alias("rate"),
        *splits,
    )
    counts = towns.groupBy("town", "region", "origin_region").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("town", "region").orderBy(F.desc("n"), "origin_region"))
    top = counts.withColumn("r", rank).where("r <= 5").groupBy("town", "region").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "origin_region"))), lambda x: x["origin_region"]), ",").alias("top_regions"))
    return base.join(top, ["town", "region"])


def origin_contributions(obs: DataFrame, destination: str) -> DataFrame:
    """The measures of one destination by contributing origin."""
    own = obs.where(F.col("destination_fias") == destination)
    return own.groupBy("origin_fias").agg(*metric_aggregates())


def data_quality(points: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of a slice's points: resolved and valid shares by points and by trips, forecast and mixed segments."""
    ok = F.col("resolved")
    pct = lambda a, b: F.when(b > 0, 100.0 * a / b).otherwise(0.0)
    out = points.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.sum(ok.cast("int")).alias("resolved_points"),
        F.sum("trip_count").alias("trips"),
        F.sum(F.when(ok, F.col("trip_count")).otherwise(0)).alias("resolved_trips"),
        F.sum(F.col("weighted_rub_per_km").isNotNull().cast("int")).alias("economic_valid"),
        F.max("has_forecast").alias("has_forecast"),
        F.max((F.instr("period_types", ",") > 0).cast("int")).alias("mixed_periods"),
    )
    return out.withColumns({"point_coverage_pct": pct(F.col("resolved_points"), F.col("points")), "trip_coverage_pct": pct(F.col("resolved_trips"), F.col("trips"))})


def baseline_filter(obs: DataFrame, region: str | None = None, origin: str | None = None, period_type: str | None = None, price_type: str | None = None) -> DataFrame:
    """Rows of a baseline: each choice that is given holds exactly."""
    for column, value in (("destination_region", region), ("origin_fias", origin), ("period_type", period_type), ("price_type", price_type)):
        if value is not None:
            obs = obs.where(F.col(column) == value)
    return obs


def data_audit(routes: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.2, 0.25, 0.3, 0.35, 0.4, 0.5)) -> DataFrame:
    """Trips and rates of the routes of each group: spread, mean rate by trips, routes above it by each threshold, and routes without a weight or a rate."""
    t, r = F.col("trip_count").cast("double"), F.col("weighted_rub_per_km")
    base = routes.groupBy(*keys).agg(weighted_mean(r, F.col("trip_count")).alias("mean_rate"))
    delta = F.when(F.col("mean_rate") > 0, r / F.col("mean_rate") - 1)
    spread = lambda c, n: [F.min(c).alias(f"{n}_least"), *[F.percentile(c, q).alias(f"{n}_p{round(100 * q)}") for q in (0.5, 0.75, 0.95, 0.99)], F.max(c).alias(f"{n}_greatest")]
    above = [F.count_if(F.coalesce(delta, F.lit(0.0)) >= x).alias(f"above_{round(100 * x)}") for x in thresholds]
    none = [F.count_if(F.coalesce(t, F.lit(0.0)) <= 0).alias("without_trips"), F.count_if(r.isNull()).alias("without_rate")]
    return routes.join(base, keys).groupBy(*keys, "mean_rate").agg(F.sum(t).alias("trips"), *spread(t, "trips"), *spread(r, "rate"), *above, *none)


#: Columns a cluster table may be sorted by.
SORTABLE = ("cluster_id", "points", "trips", "trip_share", "weighted_route_length", "price_min", "price_median", "weighted_price", "price_max", "rate_min", "rate_median", "weighted_rub_per_km", "rate_max", "economic_coverage_pct")


def cluster_table(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per cluster: size, share of trips, unweighted least, median and greatest price and rate, weighted means."""
    own = [*keys, "cluster_id"]
    t = F.col("trip_count")
    out = points.where("cluster_id >= 0").groupBy(*own).agg(
        F.count("*").alias("points"),
        F.sum("trip_count").alias("trips"),
        weighted_mean(F.col("weighted_route_length"), F.col("length_trips")).alias("weighted_route_length"),
        F.min("weighted_price").alias("price_min"), F.median("weighted_price").alias("price_median"),
        weighted_mean(F.col("weighted_price"), F.col("price_trips")).alias("weighted_price"), F.max("weighted_price").alias("price_max"),
        F.min("weighted_rub_per_km").alias("rate_min"), F.median("weighted_rub_per_km").alias("rate_median"),
        weighted_mean(F.col("weighted_rub_per_km"), F.col("rate_trips")).alias("weighted_rub_per_km"), F.max("weighted_rub_per_km").alias("rate_max"),
        F.when(F.sum(t) > 0, 100.0 * F.sum("rate_trips") / F.sum(t)).alias("economic_coverage_pct"),
    )
    return share_of_total(out, keys, "trips", "trip_share")


def share_of_total(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds a value's share of its group's total; null where that is not positive. Groups are small tables: clusters of a slice."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return df.withColumn(name, F.when(total > 0, F.col(value) / total))


def sort_table(table: DataFrame, column: str, descending: bool = False) -> DataFrame:
    if column not in SORTABLE:
        raise ValueError(f"can't sort by {column}")
    c = F.col(column)
    return table.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "cluster_id")
