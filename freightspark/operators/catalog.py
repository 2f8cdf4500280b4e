"""Lists of origins, regions and filter values, registries, and pages of source rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightspark.functions.names import with_normal_name
from freightspark.functions.order_statistics import placed_values, quantiles_of
from freightspark.functions.scalars import row_fingerprint
from freightspark.operators.economics import MISSING, modal

FACETS = ("period_type", "price_type", "vehicle_type", "tonnage_id")


def origin_catalog(obs: DataFrame) -> DataFrame:
    """Per origin: modal name and region, and trips (negative ones count as none)."""
    trips = obs.groupBy("origin_fias").agg(F.coalesce(F.sum(F.greatest(F.col("trip_count"), F.lit(0))), F.lit(0)).alias("trips"))
    for value in ("origin_name", "origin_region"):
        trips = trips.join(modal(obs, ["origin_fias"], value, value), "origin_fias", "left")
    return trips.withColumns({c: F.coalesce(c, F.lit(MISSING)) for c in ("origin_name", "origin_region")})


def facets(obs: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """Value counts of each filter column, by region."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]))
    return obs.select("destination_region", pairs.alias("f")).where("f.value is not null").groupBy("destination_region", "f.facet", "f.value").agg(F.count("*").alias("n"))


def region_origins(obs: DataFrame) -> DataFrame:
    """All origins with rows in a region, before any other filter."""
    return obs.select("destination_region", "origin_fias").where("origin_fias is not null").distinct()


def origin_search(catalog: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Origins whose name, region and id hold the text, whatever its case and spacing."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    wanted = " ".join(text.lower().split())
    return catalog.where(F.lower(F.concat_ws(" ", "origin_name", "origin_region", "origin_fias")).contains(wanted)).orderBy(F.desc("trips"), "origin_name", "origin_fias").limit(limit)


def origin_coverage(obs: DataFrame, selected: DataFrame) -> DataFrame:
    """Every selected origin with its rows and trips, and whether it has none."""
    own = obs.groupBy("origin_fias").agg(F.count("*").alias("n"), F.sum(F.when(F.col("trip_count") > 0, F.col("trip_count"))).alias("t"))
    return selected.join(own, "origin_fias", "left").select("origin_fias", F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("t", F.lit(0)).alias("trips"), F.col("n").isNull().alias("zero_match"))


def newest_first() -> list:
    """Valid period first and newest, then newest timestamp, then the last row."""
    period = F.when(F.col("period_id").rlike(r"^\d{6}$"), F.col("period_id"))
    return [period.desc_nulls_last(), F.col("tech_ts").desc_nulls_last(), F.col("row_key").desc()]


def point_rows(obs: DataFrame, destination: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of one destination's rows, newest first, with the total and whether more follow."""
    if not 1 <= limit <= 50 or offset < 0:
        raise ValueError("limit must be 1 to 50, offset not negative")
    own = obs.where(F.col("destination_fias") == destination)
    total = own.agg(F.count("*").alias("total"))
    page = own.orderBy(*newest_first()).offset(offset).limit(limit)
    return page.crossJoin(total).withColumn("has_more", F.col("total") > offset + limit)


def region_lists(obs: DataFrame) -> DataFrame:
    rows = obs.select(F.explode(F.array(F.struct(F.lit("origin").alias("side"), F.col("origin_region").alias("region")), F.struct(F.lit("destination").alias("side"), F.col("destination_region").alias("region")))).alias("r"))
    return rows.where("r.region is not null and upper(r.region) != 'NULL'").select("r.side", "r.region").distinct()


def stats(obs: DataFrame) -> DataFrame:
    return obs.agg(F.countDistinct("destination_name", "destination_region").alias("destination_towns"), F.countDistinct("destination_region").alias("destination_regions"), F.countDistinct("origin_fias").alias("origins"), F.countDistinct("origin_region").alias("origin_regions"))


def origin_registry(obs: DataFrame) -> DataFrame:
    """Per origin id the row with most attributes filled (ties: the first)."""
    filled = sum(F.col(c).isNotNull().cast("int") for c in ("origin_name", "origin_region", "destination_fias", "price", "route_length", "trip_count"))
    best = obs.where("origin_fias is not null").groupBy("origin_fias").agg(F.min(F.struct((-filled).alias("k"), "row_key", "origin_name", "origin_region")).alias("b"))
    return best.select("origin_fias", "b.origin_name", "b.origin_region", "b.row_key", (-F.col("b.k")).alias("filled"))


def origin_id_candidates(obs: DataFrame) -> DataFrame:
    """Per normalised origin town: names, ids and trips; unique iff there is one id. Forecast rows don't count."""
    rows = with_normal_name(obs.where("period_type in ('current', 'retro')"), "origin_region", "town")
    return rows.groupBy("town").agg(
        F.array_join(F.sort_array(F.collect_set("origin_name")), " | ").alias("names"),
        F.array_join(F.sort_array(F.collect_set("origin_fias")), " | ").alias("ids"),
        F.countDistinct("origin_fias").alias("candidate_count"),
        F.coalesce(F.sum(F.when(F.col("trip_count") > 0, F.col("trip_count"))), F.lit(0)).alias("trips"),
    ).withColumn("auto_unique", F.col("candidate_count") == 1)


def unique_town_match(actual: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, town) on both sides; matched iff the town has exactly one of each."""
    a = actual.groupBy("town").agg(F.count("*").alias("na"))
    b = registry.groupBy("town").agg(F.count("*").alias("nb"), F.min("registry_id").alias("registry_id"))
    both = actual.join(a, "town").join(b, "town", "left")
    one = (F.col("na") == 1) & (F.col("nb") == 1)
    return both.select("actual_id", "town", F.when(one, F.col("registry_id")).alias("registry_id"), F.when(one, "matched").when(F.col("nb").isNull(), "unmatched").otherwise("ambiguous").alias("match_status"))


def distribution(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, beside count, least, greatest and mean."""
    shares = (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))
    keys = keys or []
    placed = placed_values(df, keys, F.col(column))
    value, n = F.col("value"), F.col("n")
    whole = placed.groupBy("g").agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), (F.sum(value * n) / F.sum("n")).alias("mean"))
    whole = whole.select(*[F.col("g")[c].alias(c) for c in keys], "n", "least", "greatest", "mean")
    spread = quantiles_of(placed, keys, dict(shares))
    # a group without values has no quantiles but is there
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    out = groups
    for part in (whole, spread):
        out = _beside(out, part, keys)
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "least", *[k for k, _ in shares], "greatest", "mean")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; without keys both have one row at most."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), "left")
    other = right.select(*[F.col(c).alias(f"r_{c}") if c in keys else c for c in right.columns])
    return left.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys]), "left").drop(*[f"r_{c}" for c in keys])


def null_profile(obs: DataFrame, columns: list[str]) -> DataFrame:
    """(field, nulls, distinct) for each column: one pass, one row, then unpivoted."""
    wide = obs.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("n", lambda c: F.sum(F.col(c).isNull().cast("long"))), ("d", F.countDistinct))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("n_distinct")) for c in columns])))


def field_profile(obs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_rows, nulls, null_pct, n_distinct) of all fields: values are counted first, by field, then the counts are added up.

    One pass; no expansion of the rows for each distinct count.
    """
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields]))
    values = obs.select(each).groupBy("field", "value").agg(F.count("*").alias("n"))
    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    out = values.groupBy("field").agg(F.sum("n").alias("n_rows"), missing.alias("nulls"), F.count("value").alias("n_distinct"))
    return out.select("field", "n_rows", "nulls", (100.0 * F.col("nulls") / F.col("n_rows")).alias("null_pct"), "n_distinct")


#: The fields of the candidate business key.
BUSINESS_KEY = ("origin_fias", "destination_fias", "period_id", "period_type", "price_type", "route_type", "tonnage_id", "vehicle_type", "currency")


def audit_counts(obs: DataFrame, fields: list[str]) -> DataFrame:
    """(section, name, n): rows, repeated rows by the digest of the given fields, repeated business keys, invalid values and parse errors."""
    rows = F.struct(F.lit("rows").alias("section"), F.lit("total").alias("name"))
    whole = obs.agg(F.count("*").alias("n")).select(rows.alias("k"), "n")

    def repeats(columns: list[Column], name: str) -> DataFrame:
        groups = obs.groupBy(*columns).agg(F.count("*").alias("n"))
        return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.struct(F.lit("rows").alias("section"), F.lit(name).alias("name")).alias("k"), "n")

    known = [F.col(c) for c in BUSINESS_KEY if c in obs.columns]
    faults = {"price_negative": "price < 0", "route_length_zero": "route_length = 0", "route_length_negative": "route_length < 0", "trip_count_lt_zero": "trip_count < 0"}
    found = [F.array_compact(F.array(*[F.when(F.expr(test), F.struct(F.lit("invalid_values").alias("section"), F.lit(n).alias("name"))) for n, test in faults.items()]))]
    if "validation_errors" in obs.columns:
        found.append(F.transform("validation_errors", lambda e: F.struct(F.lit("parse_errors").alias("section"), e.alias("name"))))
    faulty = obs.select(F.explode(F.concat(*found)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    parts = [whole, repeats([row_fingerprint(*[F.col(c) for c in fields]).alias("digest")], "duplicates"), repeats(known, "duplicate_business_keys"), faulty]
    return reduce(DataFrame.union, parts).select("k.section", "k.name", "n")


def value_counts(obs: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return obs.select(pairs.alias("f")).groupBy("f.field", "f.value").agg(F.count("*").alias("n"))


def duplicates(obs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each business key."""
    groups = obs.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def route_history(obs: DataFrame) -> DataFrame:
    """How many routes have rows in at least 1, 3, 6 and 12 months; a route without ids goes by its names."""
    route = obs.select(F.coalesce("origin_fias", "origin_name").alias("a"), F.coalesce("destination_fias", "destination_name").alias("b"), "period_id")
    per = route.groupBy("a", "b").agg(F.countDistinct("period_id").alias("months"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("routes"), F.sum("n").alias("n_rows"), *[F.sum((F.col("months") >= m).cast("long")).alias(f"months_{m}") for m in (3, 6, 12)])


def region_profile(obs: DataFrame) -> DataFrame:
    return obs.groupBy("destination_region").agg(F.count("*").alias("n_rows"), F.countDistinct("destination_fias").alias("destinations"))
