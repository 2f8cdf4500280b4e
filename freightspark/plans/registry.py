"""Registered queries of the freight operators and their DuckDB twins.

Doubles are rounded to four decimals on both sides, as sums may be added in another order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightspark.functions import scalars
from freightspark.functions.shared import cut
from freightspark.operators import catalog, economics, evaluation, graph, kmeans, territory, townmap, zones
from freightspark.plans import flows, pilots
from freightspark.plans.oracle_tables import ACTUAL, COORDINATES, MAPPING, OBS
from freightspark.sources import scans
from freightspark.sources import standins as src

PLACES = 4
#: Added before rounding on both sides: prices have two decimals, so quotients often end in an exact 5.
NUDGE = 0.00000013


@dataclass(frozen=True)
class Query:
    make: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.make(spark, sf_dir)
        kinds = {f.name: f.dataType for f in out.schema}
        return out.withColumns({c: F.round(F.col(c) + NUDGE, PLACES) for c, k in kinds.items() if isinstance(k, T.DoubleType)})

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        rounded = ", ".join(f"round({c} + {NUDGE:.8f}, {PLACES}) AS {c}" for c in self.doubles)
        return self.sql if not rounded else f"SELECT * REPLACE ({rounded}) FROM ({self.sql})"


QUERIES: dict[str, Query] = {}


def add(name: str, make: Callable, sql: str | None = None, doubles: str = "", ctes: tuple[str, ...] = (OBS,)) -> None:
    text = None if sql is None else f"WITH {', '.join(c.strip() for c in ctes)} {sql}" if not sql.lstrip().startswith(",") else f"WITH {', '.join(c.strip() for c in ctes)}{sql}"
    QUERIES[name] = Query(make, text, tuple(doubles.split()))


WMEAN = "sum(CASE WHEN {v} IS NOT NULL AND {w} > 0 THEN {v} * {w} END) / nullif(sum(CASE WHEN {v} IS NOT NULL AND {w} > 0 THEN {w} END), 0)"
RATE = "CASE WHEN price > 0 AND route_length > 0 THEN price / route_length END"
LENGTH, PRICE = "CASE WHEN route_length > 0 THEN route_length END", "CASE WHEN price > 0 THEN price END"
MEASURES = f"""count(*) AS n_rows, coalesce(sum(CASE WHEN trip_count > 0 THEN trip_count END), 0)::BIGINT AS trip_count,
  {WMEAN.format(v=f'({LENGTH})', w='trip_count')} AS weighted_route_length, {WMEAN.format(v=f'({PRICE})', w='trip_count')} AS weighted_price, {WMEAN.format(v=f'({RATE})', w='trip_count')} AS weighted_rub_per_km,
  coalesce(sum(trip_count) FILTER (route_length > 0 AND trip_count > 0), 0)::BIGINT AS length_trips, coalesce(sum(trip_count) FILTER (price > 0 AND trip_count > 0), 0)::BIGINT AS price_trips,
  coalesce(sum(trip_count) FILTER (price > 0 AND route_length > 0 AND trip_count > 0), 0)::BIGINT AS rate_trips"""
THREE = "weighted_route_length weighted_price weighted_rub_per_km"


def destinations_sql(keys: str) -> str:
    sets = ", ".join(f"string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS {c}s" for c in ("period_type", "price_type", "vehicle_type", "tonnage_id"))
    return f"""SELECT {keys}, destination_fias, {MEASURES}, count(DISTINCT period_id) AS n_periods, {sets},
      max(CASE WHEN period_type = 'forecast' THEN 1 ELSE 0 END) AS has_forecast, min(destination_name) AS destination_name
      FROM obs WHERE destination_fias IS NOT NULL GROUP BY {keys}, destination_fias"""


# economics and filters
add("a1_destination_economics", lambda s, d: economics.destination_economics(src.observations(s, d), ["origin_region", "destination_region"]), destinations_sql("origin_region, destination_region"), THREE)
add("a2_rate_baseline", lambda s, d: economics.rate_baseline(src.observations(s, d)), """
, ok AS (SELECT coalesce(period_id, '<missing>') AS period_id, coalesce(origin_fias, '<missing>') AS origin_fias, coalesce(destination_fias, '<missing>') AS destination_fias, price, route_length, trip_count
  FROM obs WHERE price > 0 AND route_length > 0)
SELECT period_id, origin_fias, destination_fias, count(*) AS n_rows, coalesce(sum(trip_count) FILTER (trip_count > 0), 0)::BIGINT AS trips, sum(price) / sum(route_length) AS rate,
  sum(price * trip_count) FILTER (trip_count > 0) / nullif(sum(route_length * trip_count) FILTER (trip_count > 0), 0) AS weighted_rate, avg(price) AS mean_price, avg(route_length) AS mean_length
FROM ok GROUP BY GROUPING SETS ((), (period_id), (origin_fias), (destination_fias))""", "rate weighted_rate mean_price mean_length")
add("a4_weighted_abs_deviation", lambda s, d: economics.weighted_abs_deviation(src.observations(s, d).where("price > 0"), ["destination_region"], "price", "trip_count"), f"""
, c AS (SELECT destination_region, {WMEAN.format(v='price', w='trip_count')} AS centre FROM obs WHERE price > 0 GROUP BY 1)
SELECT destination_region, {WMEAN.format(v='abs(price - centre)', w='trip_count')} AS abs_deviation, any_value(centre) AS centre FROM obs JOIN c USING (destination_region) WHERE price > 0 GROUP BY 1""", "abs_deviation centre")
PAIRED = "coalesce(sum(price) FILTER (price > 0 AND route_length > 0{x}) / sum(route_length) FILTER (price > 0 AND route_length > 0{x}), 0.0)"
SPLIT = ", ".join(f"""{PAIRED.format(x=f" AND {c} = '{v}'")} AS rate_{v}""" for c, vs in (("period_type", ("retro", "current", "forecast")), ("price_type", ("spot", "tender"))) for v in vs)
add("a6_town_dashboard", lambda s, d: economics.town_dashboard(src.observations(s, d)), f"""
, b AS (SELECT destination_name AS town, destination_region AS region, count(*) AS n_rows, coalesce(avg(price) FILTER (price > 0), 0) AS avg_price, coalesce(min(price) FILTER (price > 0), 0) AS min_price,
  coalesce(max(price) FILTER (price > 0), 0) AS max_price, coalesce(avg(route_length) FILTER (route_length > 0), 0) AS avg_length, coalesce(avg(trip_count), 0) AS avg_bids, {PAIRED.format(x='')} AS rate, {SPLIT}
  FROM obs GROUP BY 1, 2),
t AS (SELECT destination_name AS town, destination_region AS region, origin_region, row_number() OVER (PARTITION BY destination_name, destination_region ORDER BY count(*) DESC, origin_region) AS r FROM obs GROUP BY 1, 2, 3)
SELECT b.*, top_regions FROM b JOIN (SELECT town, region, string_agg(origin_region, ',' ORDER BY r) AS top_regions FROM t WHERE r <= 5 GROUP BY 1, 2) USING (town, region)""", "avg_price min_price max_price avg_length avg_bids rate rate_retro rate_current rate_forecast rate_spot rate_tender")


def _direction_sql(side: str, where: str = "true") -> str:
    def split(kind: str, v: str, rate: bool) -> str:
        own = f"{kind} = '{v}'"
        out = f"""count(*) FILTER ({own}) AS n_{v}, coalesce(avg(price) FILTER ({own} AND price > 0), 0) AS avg_price_{v}, coalesce(avg(route_length) FILTER ({own} AND route_length > 0), 0) AS avg_length_{v}"""
        return out + (f", {PAIRED.format(x=f' AND {own}')} AS rate_{v}" if rate else "")

    top = lambda c: f"""SELECT town, region, string_agg(x || ':' || n, ',' ORDER BY n DESC, x) AS top FROM (
      SELECT town, region, {c} AS x, count(*) AS n FROM dir WHERE {c} IS NOT NULL GROUP BY 1, 2, 3
      QUALIFY row_number() OVER (PARTITION BY town, region ORDER BY count(*) DESC, {c}) <= 5) GROUP BY 1, 2"""  # noqa: E731
    splits = ", ".join([split("period_type", v, True) for v in economics.PERIODS] + [split("price_type", v, False) for v in economics.PRICES])
    return f"""
WITH dir AS (SELECT {side}_name AS town, {side}_region AS region, * FROM obs WHERE {where}),
base AS (
  SELECT town, region, count(*) AS n_rows, coalesce(avg(price) FILTER (price > 0), 0) AS avg_price, coalesce(min(price) FILTER (price > 0), 0) AS min_price, coalesce(max(price) FILTER (price > 0), 0) AS max_price,
    coalesce(avg(route_length) FILTER (route_length > 0), 0) AS avg_length, coalesce(min(route_length) FILTER (route_length > 0), 0) AS min_length, coalesce(max(route_length) FILTER (route_length > 0), 0) AS max_length,
    coalesce(avg(trip_count), 0) AS avg_bids, {PAIRED.format(x='')} AS rate, string_agg(DISTINCT period_type, ',' ORDER BY period_type) AS period_types, string_agg(DISTINCT price_type, ',' ORDER BY price_type) AS price_types,
    {splits}
  FROM dir GROUP BY 1, 2
),
conf AS (SELECT town, region, confidence FROM (SELECT town, region, confidence, count(*) AS n FROM dir WHERE confidence IS NOT NULL GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY town, region ORDER BY n DESC, confidence) = 1)
SELECT base.*, o.top AS top_origin_regions, d.top AS top_destination_regions, coalesce(confidence, '—') AS confidence, '{side}' AS side
FROM base LEFT JOIN ({top("origin_region")}) o USING (town, region) LEFT JOIN ({top("destination_region")}) d USING (town, region) LEFT JOIN conf USING (town, region)"""


DASH = "avg_price min_price max_price avg_length min_length max_length avg_bids rate " + " ".join(f"avg_price_{v} avg_length_{v}" for v in (*economics.PERIODS, *economics.PRICES)) + " " + " ".join(f"rate_{v}" for v in economics.PERIODS)
add("a6_origin_dashboard", lambda s, d: economics.direction_dashboard(src.observations(s, d), "origin"), f"SELECT * EXCLUDE (side) FROM ({_direction_sql('origin')})", DASH)
FROM, TO = [f"NATION_{k}" for k in range(0, 25, 2)], [f"NATION_{k}" for k in range(0, 25, 3)]
add(
    "p10_dashboard",
    lambda s, d: flows.dashboard(src.observations(s, d), FROM, TO, ["current", "retro"], ["spot", "tender"]),
    " UNION ALL BY NAME ".join(f"SELECT * FROM ({_direction_sql(side, f"origin_region IN {tuple(FROM)} AND destination_region IN {tuple(TO)} AND period_type IN ('current', 'retro')")})" for side in ("origin", "destination")),
    DASH,
)
add("a7_region_lists", lambda s, d: catalog.region_lists(src.observations(s, d)), "SELECT DISTINCT 'origin' AS side, origin_region AS region FROM obs UNION SELECT DISTINCT 'destination', destination_region FROM obs")
add("a7_stats", lambda s, d: catalog.stats(src.observations(s, d)), "SELECT count(DISTINCT (destination_name, destination_region)) AS destination_towns, count(DISTINCT destination_region) AS destination_regions, count(DISTINCT origin_fias) AS origins, count(DISTINCT origin_region) AS origin_regions FROM obs")
add("a8_origin_catalog", lambda s, d: catalog.origin_catalog(src.observations(s, d)), "SELECT origin_fias, min(origin_name) AS origin_name, min(origin_region) AS origin_region, coalesce(sum(greatest(trip_count, 0)), 0)::BIGINT AS trips FROM obs GROUP BY 1")
add("a9_facets", lambda s, d: catalog.facets(src.observations(s, d)), " UNION ALL ".join(f"SELECT destination_region, '{c}' AS facet, {c} AS value, count(*) AS n FROM obs WHERE {c} IS NOT NULL GROUP BY 1, 3" for c in catalog.FACETS))
add("a10_origin_registry", lambda s, d: catalog.origin_registry(src.observations(s, d)), """
, f AS (SELECT *, (origin_name IS NOT NULL)::INT + (origin_region IS NOT NULL)::INT + (destination_fias IS NOT NULL)::INT + (price IS NOT NULL)::INT + (route_length IS NOT NULL)::INT + (trip_count IS NOT NULL)::INT AS filled FROM obs)
SELECT origin_fias, origin_name, origin_region, row_key, filled FROM f QUALIFY row_number() OVER (PARTITION BY origin_fias ORDER BY filled DESC, row_key) = 1""")
add("a11_origin_id_candidates", lambda s, d: catalog.origin_id_candidates(src.observations(s, d)), """SELECT lower(origin_region) AS town, string_agg(DISTINCT origin_name, ' | ' ORDER BY origin_name) AS names, string_agg(DISTINCT origin_fias, ' | ' ORDER BY origin_fias) AS ids,
  count(DISTINCT origin_fias) AS candidate_count, coalesce(sum(trip_count) FILTER (trip_count > 0), 0)::BIGINT AS trips, count(DISTINCT origin_fias) = 1 AS auto_unique FROM obs WHERE period_type <> 'forecast' GROUP BY 1""")
add("a12_null_profile", lambda s, d: catalog.null_profile(src.observations(s, d), ["origin_fias", "destination_fias", "price", "route_length", "trip_count", "period_id"]), " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct FROM obs" for c in ("origin_fias", "destination_fias", "price", "route_length", "trip_count", "period_id")))
FIELDS = (
    "row_key", "origin_fias", "origin_name", "origin_region", "origin_nation", "destination_fias", "destination_name", "destination_region", "continent", "period_id", "period_type",
    "price_type", "price", "route_length", "trip_count", "vehicle_type", "tonnage_id", "tech_ts", "confidence",
)
add(
    "a12_field_profile",
    lambda s, d: catalog.field_profile(src.observations(s, d), list(FIELDS)),
    " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n_rows, count(*) - count({c}) AS nulls, 100.0 * (count(*) - count({c})) / count(*) AS null_pct, count(DISTINCT {c}) AS n_distinct FROM obs" for c in FIELDS),
    "null_pct",
)
DIGESTED = [c for c in FIELDS if c not in ("row_key", "tech_ts", "tonnage_id", "price", "origin_name")]
add(
    "a12_audit_counts",
    lambda s, d: catalog.audit_counts(src.observations(s, d), DIGESTED),
    f"""SELECT 'rows' AS section, 'total' AS name, count(*) AS n FROM obs
UNION ALL SELECT 'rows', 'duplicates', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM obs GROUP BY {", ".join(f"coalesce({c}::VARCHAR, '')" for c in DIGESTED)})
UNION ALL SELECT 'rows', 'duplicate_business_keys', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM obs GROUP BY origin_fias, destination_fias, period_id, period_type, price_type, tonnage_id, vehicle_type)
UNION ALL SELECT 'invalid_values', 'route_length_zero', n FROM (SELECT count(*) AS n FROM obs WHERE route_length = 0) WHERE n > 0
UNION ALL SELECT 'invalid_values', 'price_negative', n FROM (SELECT count(*) AS n FROM obs WHERE price < 0) WHERE n > 0""",
)
add("a12_value_counts", lambda s, d: catalog.value_counts(src.observations(s, d), ["period_type", "price_type", "vehicle_type"]), " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM obs GROUP BY 2" for c in ("period_type", "price_type", "vehicle_type")))
add("a12_duplicates", lambda s, d: catalog.duplicates(src.observations(s, d), ["origin_fias", "destination_fias", "period_id", "price_type"]), "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM obs GROUP BY origin_fias, destination_fias, period_id, price_type)")
add("a12_region_profile", lambda s, d: catalog.region_profile(src.observations(s, d)), "SELECT destination_region, count(*) AS n_rows, count(DISTINCT destination_fias) AS destinations FROM obs GROUP BY 1")
QS = ", ".join(f"quantile_cont(price, {q}) AS {n}" for n, q in (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))
add("a13_distribution", lambda s, d: catalog.distribution(src.observations(s, d), "price", ["destination_region"]), f"SELECT destination_region, count(price) AS n, min(price) AS least, {QS}, max(price) AS greatest, avg(price) AS mean FROM obs GROUP BY 1", "least p01 p05 p25 median p75 p95 p99 greatest mean")
add("a14_route_history", lambda s, d: catalog.route_history(src.observations(s, d)), """SELECT count(*) AS routes, sum(n)::BIGINT AS n_rows, sum((m >= 3)::INT)::BIGINT AS months_3, sum((m >= 6)::INT)::BIGINT AS months_6, sum((m >= 12)::INT)::BIGINT AS months_12 FROM
  (SELECT count(DISTINCT period_id) AS m, count(*) AS n FROM obs GROUP BY coalesce(origin_fias, origin_name), coalesce(destination_fias, destination_name))""")
add("a26_origin_contributions", lambda s, d: economics.origin_contributions(src.observations(s, d), "c1"), f"SELECT origin_fias, {MEASURES} FROM obs WHERE destination_fias = 'c1' GROUP BY 1", THREE)
add("f1_slice_filter", lambda s, d: economics.slice_filter(src.observations(s, d), ["s1", "s2", "s3"], None, period_type=["current"], price_type=["spot", "tender"]).groupBy("origin_fias").agg(*economics.metric_aggregates()), f"SELECT origin_fias, {MEASURES} FROM obs WHERE origin_fias IN ('s1', 's2', 's3') AND period_type = 'current' GROUP BY 1", THREE)
add("f6_region_origins", lambda s, d: catalog.region_origins(src.observations(s, d)), "SELECT DISTINCT destination_region, origin_fias FROM obs")
add("f7_origin_search", lambda s, d: catalog.origin_search(catalog.origin_catalog(src.observations(s, d)), "  supplier#00000000 ", 20), """SELECT origin_fias, min(origin_name) AS origin_name, min(origin_region) AS origin_region, coalesce(sum(greatest(trip_count, 0)), 0)::BIGINT AS trips FROM obs GROUP BY 1
  HAVING contains(lower(min(origin_name) || ' ' || min(origin_region) || ' ' || origin_fias), 'supplier#00000000') ORDER BY trips DESC, origin_name, origin_fias LIMIT 20""")
PAGE = "row_key origin_fias destination_fias period_id price total has_more".split()
add("f8_point_rows", lambda s, d: catalog.point_rows(src.observations(s, d), "c1", 5, 20).select(*PAGE), """SELECT row_key, origin_fias, destination_fias, period_id, price, (SELECT count(*) FROM obs WHERE destination_fias = 'c1') AS total, (SELECT count(*) FROM obs WHERE destination_fias = 'c1') > 25 AS has_more
  FROM obs WHERE destination_fias = 'c1' ORDER BY period_id DESC, tech_ts DESC, row_key DESC LIMIT 20 OFFSET 5""", "price")
add("j7_origin_coverage", lambda s, d: catalog.origin_coverage(src.observations(s, d).where("destination_region = 'NATION_3'"), src.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("origin_fias"))), """SELECT 's' || s_suppkey AS origin_fias, count(o.row_key) AS n_rows, coalesce(sum(trip_count) FILTER (trip_count > 0), 0)::BIGINT AS trips, count(o.row_key) = 0 AS zero_match
  FROM supplier LEFT JOIN (SELECT * FROM obs WHERE destination_region = 'NATION_3') o ON o.origin_fias = 's' || s_suppkey GROUP BY 1""")


def _towns(s: SparkSession, d: str) -> DataFrame:
    """Town keys of which a part stays unique at every size: every third customer and every second supplier has a town of its own."""
    c, k = F.col("c_custkey"), F.col("s_suppkey")
    town = lambda own, rest: F.when(own, F.concat(F.lit("t"), rest[0].cast("string"))).otherwise(F.concat(F.lit("shared"), rest[1].cast("string")))
    a = src.table(s, d, "customer").select(c.cast("string").alias("actual_id"), town(c % 3 == 0, (c, c % 97)).alias("town"))
    b = src.table(s, d, "supplier").select(k.cast("string").alias("registry_id"), town(k % 2 == 0, (k, k % 61)).alias("town"))
    return catalog.unique_town_match(a, b)


add(
    "j5_unique_town_match",
    _towns,
    """, a0 AS (SELECT c_custkey::VARCHAR AS actual_id, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey ELSE 'shared' || (c_custkey % 97) END AS town FROM customer),
a AS (SELECT *, count(*) OVER (PARTITION BY town) AS na FROM a0),
b AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 't' || s_suppkey ELSE 'shared' || (s_suppkey % 61) END AS town, count(*) AS nb, min(s_suppkey::VARCHAR) AS registry_id FROM supplier GROUP BY 1)
SELECT actual_id, town, CASE WHEN na = 1 AND nb = 1 THEN registry_id END AS registry_id,
  CASE WHEN na = 1 AND nb = 1 THEN 'matched' WHEN nb IS NULL THEN 'unmatched' ELSE 'ambiguous' END AS match_status FROM a LEFT JOIN b USING (town)""",
)
add("n10_row_fingerprint", lambda s, d: src.observations(s, d).select("row_key", scalars.row_fingerprint(*[F.col(c) for c in ("origin_fias", "destination_fias", "period_id", "period_type", "trip_count")]).alias("fingerprint")), "SELECT row_key, sha256(concat(origin_fias, chr(31), coalesce(destination_fias, ''), chr(31), period_id, chr(31), period_type, chr(31), coalesce(trip_count::VARCHAR, ''))) AS fingerprint FROM obs")
add("n16_haversine", lambda s, d: src.places(s, d).select("c_custkey", scalars.haversine_m(F.col("lat"), F.col("lon"), F.lit(55.0), F.lit(37.0)).alias("metres")), "SELECT c_custkey, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(55.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(55.0)) * pow(sin(radians(37.0 - lon) / 2), 2)))) AS metres FROM geo", "metres")

# evaluation
TRUTH = """
, truth AS (SELECT *, CASE WHEN fact_rub_per_item IS NULL THEN 'missing' WHEN horizon < 0 THEN 'final_post_shipment' WHEN horizon = 0 THEN 'm0_only' ELSE 'pre_shipment_only' END AS truth_status
  FROM act QUALIFY row_number() OVER (PARTITION BY shipment_month, actual_origin_id, destination_region ORDER BY (fact_rub_per_item IS NOT NULL) DESC, snapshot_month DESC) = 1)"""
CELLS = """
, cells AS (SELECT origin_fias, continent AS destination_region, period_id, avg(price) FILTER (price > 0) AS pulse_price,
  sum(price * greatest(coalesce(trip_count, 0), 0)) FILTER (price > 0) / nullif(sum(greatest(coalesce(trip_count, 0), 0)) FILTER (price > 0), 0) AS pulse_trip_weighted_price,
  sum(price) FILTER (price > 0 AND route_length > 0) / nullif(sum(route_length) FILTER (price > 0 AND route_length > 0), 0) AS pulse_rub_per_km,
  sum(price * greatest(coalesce(trip_count, 0), 0)) FILTER (price > 0) / nullif(sum(route_length * greatest(coalesce(trip_count, 0), 0)) FILTER (price > 0 AND route_length > 0), 0) AS pulse_weighted_rub_per_km,
  string_agg(DISTINCT period_type, ',' ORDER BY period_type) AS period_types FROM obs GROUP BY 1, 2, 3)"""
DATASET = TRUTH + CELLS + """
, exact AS (SELECT origin_fias, destination_region, shipment_month, count(*) AS n, min(distance_km) AS km FROM dist WHERE shipment_month IS NOT NULL GROUP BY 1, 2, 3),
loose AS (SELECT origin_fias, destination_region, count(*) AS n, min(distance_km) AS km FROM dist WHERE shipment_month IS NULL GROUP BY 1, 2),
ev AS (SELECT t.shipment_month, t.actual_origin_id, t.destination_region, t.fact_rub_per_item AS actual_price, t.qty_total AS qty, t.horizon, t.auction_percent, t.market_rub_per_item, t.truth_status,
  coalesce(match_status, 'unmatched') AS origin_status, CASE WHEN match_status = 'matched' THEN m.origin_fias END AS origin_fias, pulse_price, pulse_trip_weighted_price, pulse_rub_per_km,
  CASE WHEN pulse_price IS NOT NULL THEN 'matched' ELSE 'missing' END AS price_status, coalesce(e.n, l.n, 0) AS dn, CASE WHEN coalesce(e.n, l.n) = 1 THEN coalesce(e.km, l.km) END AS distance_km
  FROM truth t LEFT JOIN mapping m USING (actual_origin_id)
  LEFT JOIN cells c ON match_status = 'matched' AND c.origin_fias = m.origin_fias AND c.destination_region = t.destination_region AND c.period_id = replace(t.shipment_month, '-', '')
  LEFT JOIN exact e ON match_status = 'matched' AND e.origin_fias = m.origin_fias AND e.destination_region = t.destination_region AND e.shipment_month = t.shipment_month
  LEFT JOIN loose l ON match_status = 'matched' AND l.origin_fias = m.origin_fias AND l.destination_region = t.destination_region)"""
PRED = DATASET + """
, pred AS (SELECT shipment_month, actual_origin_id, destination_region, actual_price, qty, horizon, auction_percent, unnest([{'v': 'E0', 'p': pulse_price}, {'v': 'E0_trip_weighted', 'p': pulse_trip_weighted_price}, {'v': 'E1', 'p': pulse_rub_per_km * distance_km}, {'v': 'E2', 'p': NULL::DOUBLE}, {'v': 'E3', 'p': NULL::DOUBLE}, {'v': 'ATI_REF', 'p': market_rub_per_item}], recursive := true) FROM ev),
ok AS (SELECT *, v AS variant, p AS predicted, 100 * abs(p - actual_price) / actual_price AS ape FROM pred WHERE actual_price > 0 AND qty > 0 AND p IS NOT NULL)"""
METRICS = """count(*) AS cells, sum(qty) AS qty, 100 * sum(qty * abs(predicted - actual_price)) / sum(qty * actual_price) AS wape_pct, sum(qty * abs(predicted - actual_price)) / sum(qty) AS weighted_mae, median(ape) AS mdape_pct,
  100 * sum(qty * (predicted - actual_price)) / sum(qty * actual_price) AS bias_pct, 100 * coalesce(sum(qty) FILTER (ape <= 10), 0) / sum(qty) AS within_10_pct, 100 * coalesce(sum(qty) FILTER (ape <= 20), 0) / sum(qty) AS within_20_pct"""
MD = "qty wape_pct weighted_mae mdape_pct bias_pct within_10_pct within_20_pct"
EVAL, ACT = (OBS, ACTUAL, MAPPING), (OBS, ACTUAL)


def _rows(s: SparkSession, d: str) -> DataFrame:
    return flows.evaluation_rows(src.observations(s, d), src.actual_snapshots(s, d), src.origin_mapping(s, d), src.distances(s, d))


def _predictions(s: SparkSession, d: str) -> DataFrame:
    return evaluation.predictions(_rows(s, d))


def _flawed(s: SparkSession, d: str) -> DataFrame:
    """Snapshots of which some break a rule, some two, and some stand there twice."""
    rows = src.actual_snapshots(s, d)
    h, q = F.col("horizon"), F.col("qty_total")
    broken = rows.withColumns({
        "auction_percent": F.when(h == 3, 1.5).otherwise(F.col("auction_percent")),
        "market_rub_per_item": F.when(h.isin(2, 3), -F.col("market_rub_per_item")).otherwise(F.col("market_rub_per_item")),
        "fact_rub_per_item": F.when(h == -1, F.col("fact_rub_per_item") * 1.2).otherwise(F.col("fact_rub_per_item")),
    })
    return broken.union(broken.where((h == 0) & (q > 0)))


add(
    "s4_snapshot_rejects",
    lambda s, d: evaluation.check_snapshots(_flawed(s, d))[1].groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n")),
    """, b AS (SELECT snapshot_month, shipment_month, actual_origin_id, destination_region, horizon, qty_total, fact_rub_total, CASE WHEN horizon = 3 THEN 1.5 ELSE auction_percent END AS ap,
  CASE WHEN horizon IN (2, 3) THEN -market_rub_per_item ELSE market_rub_per_item END AS mk, CASE WHEN horizon = -1 THEN fact_rub_per_item * 1.2 ELSE fact_rub_per_item END AS f FROM act),
w AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE horizon = 0 AND qty_total > 0),
e AS (SELECT concat_ws(',', CASE WHEN f < 0 THEN 'negative_fact_rub_per_item' END, CASE WHEN mk < 0 THEN 'negative_market_rub_per_item' END, CASE WHEN ap < 0 OR ap > 1 THEN 'auction_percent_scale' END,
  CASE WHEN qty_total > 0 AND f > 0 AND abs(fact_rub_total / qty_total - f) / f > 0.05 THEN 'price_mismatch' END,
  CASE WHEN count(*) OVER (PARTITION BY snapshot_month, shipment_month, actual_origin_id, destination_region) > 1 THEN 'duplicate_key' END) AS errors FROM w)
SELECT errors, count(*) AS n FROM e WHERE errors <> '' GROUP BY 1""",
    ctes=ACT,
)
add("f11_as_of", lambda s, d: evaluation.as_of(src.actual_snapshots(s, d), "1997-06").groupBy("snapshot_month").agg(F.count("*").alias("n")), "SELECT snapshot_month, count(*) AS n FROM act WHERE snapshot_month <= '1997-06' GROUP BY 1", ctes=ACT)
add("a16_ground_truth", lambda s, d: evaluation.ground_truth(src.actual_snapshots(s, d)).select(*evaluation.KEY, "snapshot_month", "horizon", "qty", "actual_price", "truth_status"), TRUTH + " SELECT shipment_month, actual_origin_id, destination_region, snapshot_month, horizon, qty_total AS qty, fact_rub_per_item AS actual_price, truth_status FROM truth", "qty actual_price", ACT)
REV = " UNION ALL ".join(f"SELECT '{c}' AS metric, arg_min({{'x': {c}}}, snapshot_month).x AS a, arg_max({{'x': {c}}}, snapshot_month).x AS b FROM act GROUP BY shipment_month, actual_origin_id, destination_region" for c in ("fact_rub_per_item", "market_rub_per_item", "qty_total", "auction_percent"))
add("a17_revision_report", lambda s, d: evaluation.revision_report(src.actual_snapshots(s, d)), f""", e AS ({REV}), m AS (SELECT metric, abs(b - a) / abs(a) AS r FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND a <> 0)
SELECT metric, count(*) AS n, sum((r > 0.01)::INT)::BIGINT AS over_1, sum((r > 0.05)::INT)::BIGINT AS over_5, avg((r > 0.01)::INT) AS share_1, avg((r > 0.05)::INT) AS share_5 FROM m GROUP BY 1""", "share_1 share_5", ACT)
add("a18_market_history", lambda s, d: evaluation.market_history(src.actual_snapshots(s, d)).select(*evaluation.KEY, F.explode("market_by_horizon").alias("horizon", "price")), "SELECT shipment_month, actual_origin_id, destination_region, horizon, arg_max(market_rub_per_item, snapshot_month) AS price FROM act WHERE market_rub_per_item > 0 GROUP BY 1, 2, 3, 4", "price", ACT)
add("a19_actual_audit", lambda s, d: evaluation.actual_audit(src.actual_snapshots(s, d)), "SELECT v AS versions, count(*) AS n_keys, sum(f)::BIGINT AS with_fact, sum(q) AS qty FROM (SELECT count(*) AS v, max((fact_rub_per_item IS NOT NULL)::INT) AS f, sum(qty_total) AS q FROM act GROUP BY shipment_month, actual_origin_id, destination_region) GROUP BY 1", "qty", ACT)
add("a20_price_cells", lambda s, d: evaluation.price_cells(src.observations(s, d)), CELLS + " SELECT * FROM cells", "pulse_price pulse_trip_weighted_price pulse_rub_per_km pulse_weighted_rub_per_km")
EV = "shipment_month actual_origin_id destination_region actual_price qty truth_status origin_status price_status distance_km".split()
add("j3_evaluation_dataset", lambda s, d: _rows(s, d).select(*EV, "distance_status"), DATASET + f" SELECT {', '.join(EV)}, CASE WHEN dn = 0 THEN 'missing' WHEN dn = 1 THEN 'matched' ELSE 'ambiguous' END AS distance_status FROM ev", "actual_price qty distance_km", EVAL)
COVER = ", ".join(f"avg(({t})::INT) AS {n}_cells, sum(CASE WHEN {t} THEN greatest(coalesce(qty, 0), 0) ELSE 0 END) / nullif(sum(greatest(coalesce(qty, 0), 0)), 0) AS {n}_qty" for n, t in (("truth", "actual_price IS NOT NULL"), ("origin", "origin_fias IS NOT NULL"), ("price", "pulse_price IS NOT NULL"), ("distance", "dn = 1"), ("cluster", "false")))
COVERS = " ".join(f"{n}_{k}" for n in ("truth", "origin", "price", "distance", "cluster") for k in ("cells", "qty"))
add("a21_coverage_report", lambda s, d: evaluation.coverage_report(_rows(s, d)), DATASET + f" SELECT count(*) AS cells, {COVER} FROM ev", COVERS, EVAL)
add("e1_variant_coverage", lambda s, d: evaluation.coverage(_predictions(s, d)), PRED + " SELECT v AS variant, sum((p IS NOT NULL)::INT)::BIGINT AS predicted_cells, coalesce(coalesce(sum(greatest(coalesce(qty, 0), 0)) FILTER (p IS NOT NULL), 0) / nullif(sum(greatest(coalesce(qty, 0), 0)), 0), 0) AS coverage, CASE WHEN bool_or(p IS NOT NULL) THEN 'evaluated' ELSE 'blocked' END AS status FROM pred GROUP BY 1", "coverage", EVAL)
add("a22_metrics", lambda s, d: evaluation.metrics(_predictions(s, d), ["variant"]), PRED + f" SELECT variant, {METRICS} FROM ok GROUP BY 1", MD, EVAL)
add("a23_segment_metrics", lambda s, d: evaluation.segment_metrics(_predictions(s, d)), PRED + f"""
, q AS (SELECT coalesce(qty, 0) AS q, row_number() OVER (ORDER BY coalesce(qty, 0)) - 1 AS i, count(*) OVER () AS n FROM ev),
t AS (SELECT min(q) FILTER (i = n // 4) AS t1, min(q) FILTER (i = n // 2) AS t2, min(q) FILTER (i = 3 * n // 4) AS t3 FROM q),
s AS (SELECT ok.*, unnest([{{'dimension': 'shipment_month', 'label': shipment_month}}, {{'dimension': 'origin', 'label': actual_origin_id}}, {{'dimension': 'destination_region', 'label': destination_region}}, {{'dimension': 'target_horizon', 'label': 'M' || horizon}},
  {{'dimension': 'volume_quantile', 'label': CASE WHEN qty <= t1 THEN 'Q1' WHEN qty <= t2 THEN 'Q2' WHEN qty <= t3 THEN 'Q3' ELSE 'Q4' END}},
  {{'dimension': 'auction_percent_posthoc', 'label': CASE WHEN auction_percent IS NULL THEN 'missing' WHEN auction_percent = 0 THEN '0' WHEN auction_percent <= 0.25 THEN '(0,0.25]' WHEN auction_percent <= 0.5 THEN '(0.25,0.5]' WHEN auction_percent <= 0.75 THEN '(0.5,0.75]' ELSE '(0.75,1]' END}}], recursive := true) FROM ok, t)
SELECT variant, dimension, label, {METRICS} FROM s GROUP BY 1, 2, 3""", MD, EVAL)
add("e2_by_horizon", lambda s, d: evaluation.by_horizon(_rows(s, d)), DATASET + f""", h AS (SELECT shipment_month, actual_origin_id, destination_region, horizon AS h, arg_max(market_rub_per_item, snapshot_month) AS predicted FROM act WHERE market_rub_per_item > 0 GROUP BY 1, 2, 3, 4),
o AS (SELECT h.h, predicted, actual_price, qty, 100 * abs(predicted - actual_price) / actual_price AS ape FROM h JOIN ev USING (shipment_month, actual_origin_id, destination_region) WHERE actual_price > 0 AND qty > 0)
SELECT h, {METRICS} FROM o GROUP BY 1""", MD, EVAL)
add("e3_leaderboard", lambda s, d: evaluation.leaderboard(_predictions(s, d)), PRED + f"""
, b AS (SELECT shipment_month, actual_origin_id, destination_region, predicted AS bp FROM ok WHERE variant = 'E0'), c AS (SELECT * FROM ok JOIN b USING (shipment_month, actual_origin_id, destination_region)),
w AS (SELECT variant, 100 * sum(qty * abs(bp - actual_price)) / sum(qty * actual_price) AS bw FROM c GROUP BY 1)
SELECT variant, {METRICS}, 'all_available' AS scope, NULL::DOUBLE AS gain_pct FROM ok GROUP BY 1
UNION ALL SELECT x.* EXCLUDE (bw), CASE WHEN bw > 0 THEN 100 * (bw - wape_pct) / bw END FROM (SELECT variant, {METRICS}, 'common_with_base' AS scope FROM c GROUP BY 1) x JOIN w USING (variant)""".replace("x.* EXCLUDE (bw)", "x.*"), MD + " gain_pct", EVAL)
PAIRS = """, pr AS (SELECT a.shipment_month, a.actual_origin_id, a.destination_region, a.actual_price, a.qty, a.p AS pa, b.p AS pb FROM (SELECT * FROM ok WHERE v = 'ATI_REF') a JOIN (SELECT * FROM ok WHERE v = 'E0') b USING (shipment_month, actual_origin_id, destination_region))"""
add(
    "e4_paired_bootstrap",
    lambda s, d: evaluation.paired_bootstrap(cut(_predictions(s, d), "predictions"), "ATI_REF"),
    PRED + PAIRS + f""", it AS (SELECT pr.*, i, (('0x' || substr(md5(concat_ws('|', '42', i::VARCHAR, shipment_month, actual_origin_id, destination_region)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM pr, (SELECT unnest(range(-1, 1000)) AS i)),
w AS (SELECT *, qty * CASE WHEN i < 0 THEN 1 ELSE {' + '.join(f'(u > {c!r}::DOUBLE)::INT' for c in evaluation.POISSON_STEPS)} END AS q FROM it),
d AS (SELECT i, count(*) AS pairs, 100 * (sum(q * abs(pa - actual_price)) - sum(q * abs(pb - actual_price))) / sum(q * actual_price) AS delta FROM w GROUP BY 1 HAVING sum(q * actual_price) > 0),
l AS (SELECT list(delta ORDER BY delta) FILTER (i >= 0) AS ds, max(pairs) AS pairs, count(*) FILTER (i >= 0) AS iterations, max(delta) FILTER (i < 0) AS delta_wape_pct FROM d)
SELECT pairs, iterations, delta_wape_pct, ds[1 + floor(0.025 * (len(ds) - 1))::INT] AS ci_low, ds[1 + floor(0.975 * (len(ds) - 1))::INT] AS ci_high FROM l""",
    "delta_wape_pct ci_low ci_high",
    EVAL,
)
_wape = lambda c: f"100 * sum(qty * abs({c} - actual_price)) / sum(qty * actual_price)"
add(
    "e5_success_gate",
    lambda s, d: evaluation.success_gate(cut(_predictions(s, d), "predictions"), "ATI_REF"),
    PRED + PAIRS + f""", wh AS (SELECT {_wape('pa')} AS vw, {_wape('pb')} AS bw, {_wape('pa').replace('abs', '')} AS v_bias, {_wape('pb').replace('abs', '')} AS b_bias FROM pr),
mo AS (SELECT count(*) AS months, coalesce(sum((v < b)::INT), 0)::BIGINT AS improved FROM (SELECT {_wape('pa')} AS v, {_wape('pb')} AS b FROM pr GROUP BY shipment_month)),
g AS (SELECT *, CASE WHEN bw > 0 THEN 100 * (bw - vw) / bw END AS gain_pct FROM wh, mo)
SELECT gain_pct, v_bias, b_bias, months, improved, coalesce(gain_pct >= 5 AND abs(v_bias) <= abs(b_bias) + 1 AND improved >= greatest(2, ceil(months / 2.0)), false) AS passed FROM g""",
    "gain_pct v_bias b_bias",
    EVAL,
)
add("e6_decision_gate", lambda s, d: evaluation.decision_gate(evaluation.coverage_report(_rows(s, d))), DATASET + f", r AS (SELECT {COVER} FROM ev) SELECT truth_qty >= 0.9 AND origin_qty >= 0.9 AS ready, distance_qty >= 0.8 AS distance_ready, cluster_qty >= 0.8 AS cluster_ready FROM r", "", EVAL)
add("j6_common_keys", lambda s, d: evaluation.common_keys(_predictions(s, d), ["E0", "E1", "ATI_REF"]), PRED + " SELECT shipment_month, actual_origin_id, destination_region FROM pred WHERE v IN ('E0', 'E1', 'ATI_REF') AND p IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 3", "", EVAL)


def _train_test(s: SparkSession, d: str) -> DataFrame:
    obs = src.observations(s, d)
    label = src.places(s, d).select("destination_region", "destination_fias", (F.col("c_custkey") % 3).cast("int").alias("cluster_id")).where("cluster_id > 0")
    return evaluation.rate_train_test(obs, label, ["199601", "199602", "199603"], ["199604", "199605"])


add("a24_rate_train_test", _train_test, """
, okr AS (SELECT o.*, greatest(coalesce(trip_count, 0), 1) AS w, CASE WHEN g.c_custkey % 3 > 0 THEN g.c_custkey % 3 END AS cluster_id FROM obs o LEFT JOIN geo g ON g.destination_fias = o.destination_fias WHERE price > 0 AND route_length > 0),
reg AS (SELECT destination_region, sum(price * w) / sum(route_length * w) AS rr FROM okr WHERE period_id IN ('199601', '199602', '199603') GROUP BY 1),
clu AS (SELECT destination_region, cluster_id, sum(price * w) / sum(route_length * w) AS cr FROM okr WHERE period_id IN ('199601', '199602', '199603') AND cluster_id IS NOT NULL GROUP BY 1, 2),
h AS (SELECT okr.*, rr, cr, (cr IS NOT NULL AND rr IS NOT NULL) AS known FROM okr LEFT JOIN reg USING (destination_region) LEFT JOIN clu ON clu.destination_region = okr.destination_region AND clu.cluster_id = okr.cluster_id WHERE period_id IN ('199604', '199605')),
a AS (SELECT period_id, count(*) AS n_rows, sum((NOT known)::INT)::BIGINT AS unmatched, 100 * sum(w * abs(rr * route_length - price)) FILTER (known) / sum(w * price) FILTER (known) AS regional_wape, 100 * sum(w * abs(cr * route_length - price)) FILTER (known) / sum(w * price) FILTER (known) AS cluster_wape FROM h GROUP BY ROLLUP (period_id))
SELECT *, CASE WHEN regional_wape > 0 THEN 100 * (regional_wape - cluster_wape) / regional_wape END AS gain_pct FROM a""", "regional_wape cluster_wape gain_pct")
add("a25_distance_hypothesis", lambda s, d: evaluation.distance_hypothesis(src.observations(s, d).select("origin_fias", F.col("continent").alias("destination_region"), "period_id", "price", "route_length", "trip_count", F.lit(True).alias("market"), F.col("destination_fias").isNotNull().alias("trip"))), CELLS + """
, me AS (SELECT avg(pulse_rub_per_km) AS mr, avg(pulse_price) AS mp FROM cells),
r AS (SELECT o.price AS ref, o.trip_count AS t, o.route_length AS l, c.pulse_rub_per_km AS k, mr, mp FROM obs o LEFT JOIN cells c ON c.origin_fias = o.origin_fias AND c.destination_region = o.continent AND c.period_id = o.period_id, me WHERE o.destination_fias IS NOT NULL),
x AS (SELECT ref, t, unnest([{'variant': 'cell_rate', 'p': k * l}, {'variant': 'mean_rate', 'p': mr * l}, {'variant': 'mean_price', 'p': mp}], recursive := true) FROM r),
y AS (SELECT *, coalesce(ref > 0 AND t > 0 AND p IS NOT NULL, false) AS good FROM x)
SELECT variant, avg(CASE WHEN ref > 0 AND t > 0 AND p IS NOT NULL THEN 1.0 WHEN NOT (ref > 0 AND t > 0) OR p IS NULL AND ref > 0 AND t > 0 OR p IS NULL AND NOT coalesce(ref > 0 AND t > 0, true) THEN 0.0 WHEN p IS NULL THEN 0.0 END) AS coverage,
  100 * sum(t * abs(p - ref)) FILTER (good) / sum(t * ref) FILTER (good) AS wape_pct, median(100 * abs(p - ref) / ref) FILTER (good) AS mdape_pct FROM y GROUP BY 1""", "coverage wape_pct mdape_pct")


# coordinates, graphs, zones
def _points(s: SparkSession, d: str) -> DataFrame:
    return cut(flows.graph_points(flows.measured_points(src.observations(s, d), src.coordinates(s, d))), "points")


def _edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points = _points(s, d)
    edges, threshold = flows.spatial_graph(points)
    return points, edges, threshold


RESOLVED = f""", routes AS ({destinations_sql('destination_region')}),
pts AS (SELECT r.*, CASE WHEN e.lat IS NOT NULL THEN e.lat ELSE n.lat END AS lat, CASE WHEN e.lat IS NOT NULL THEN e.lon ELSE n.lon END AS lon,
  CASE WHEN e.lat IS NOT NULL THEN 'cache_exact' WHEN n.lat IS NOT NULL THEN 'cache_normalized' WHEN e.name IS NOT NULL OR n.name IS NOT NULL THEN 'cache_null' ELSE 'not_in_cache' END AS coordinate_source,
  coalesce(e.lat, n.lat) IS NOT NULL AS resolved
  FROM routes r LEFT JOIN coords e ON e.name = r.destination_name AND e.region = r.destination_region
  LEFT JOIN coords n ON n.name = CASE WHEN starts_with(r.destination_name, 'г ') THEN substr(r.destination_name, 3) ELSE r.destination_name END AND n.region = r.destination_region)"""
PROJECTED = RESOLVED + """
, cen AS (SELECT destination_region AS slice, avg(lat) AS lat0, avg(lon) AS lon0 FROM pts WHERE resolved GROUP BY 1),
ang AS (SELECT destination_region AS slice, destination_fias AS id, radians(lat) AS p, radians(lat0) AS p0, radians(lon - lon0) AS dl, trip_count, weighted_price, weighted_rub_per_km FROM pts JOIN cen ON slice = destination_region WHERE resolved),
arc AS (SELECT *, acos(least(1.0, greatest(-1.0, sin(p0) * sin(p) + cos(p0) * cos(p) * cos(dl)))) AS c FROM ang),
gp AS (SELECT slice, id, k * cos(p) * sin(dl) AS x, k * (cos(p0) * sin(p) - sin(p0) * cos(p) * cos(dl)) AS y, trip_count, weighted_price, weighted_rub_per_km
  FROM (SELECT *, CASE WHEN abs(c) < 1e-12 THEN 1.0 ELSE c / sin(c) END * 6371008.8 AS k FROM arc))"""
NEAREST = PROJECTED + """
, pw AS (SELECT a.slice, a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM gp a JOIN gp b ON a.slice = b.slice AND a.id <> b.id),
nn AS (SELECT slice, a AS id, min(distance) AS nearest FROM pw GROUP BY 1, 2)"""
LIMIT = NEAREST + """
, md AS (SELECT slice, median(nearest) AS m FROM nn GROUP BY 1), mad AS (SELECT slice, any_value(m) AS m, median(abs(nearest - m)) AS mad FROM nn JOIN md USING (slice) GROUP BY 1),
lim AS (SELECT slice, CASE WHEN mad > 0 THEN m + 3 * 1.4826 * mad ELSE 3 * m END AS threshold FROM mad)"""
EDGES = LIMIT + """
, cand AS (SELECT * FROM pw JOIN lim USING (slice) WHERE a < b AND distance > 0 AND distance <= threshold),
third AS (SELECT c.slice, c.a, c.b, c.distance, ((g.x - (ax + bx) / 2) * (ay - by_) + (g.y - (ay + by_) / 2) * (bx - ax)) / distance AS d,
  pow(g.x - (ax + bx) / 2, 2) + pow(g.y - (ay + by_) / 2, 2) - distance * distance / 4 AS w FROM cand c JOIN gp g ON g.slice = c.slice AND g.id <> c.a AND g.id <> c.b),
rim AS (SELECT slice, a, b, distance, max(w / (2 * d)) FILTER (d < -1e-9 * distance) AS low, min(w / (2 * d)) FILTER (d > 1e-9 * distance) AS high, min(w) FILTER (abs(d) <= 1e-9 * distance) AS flat FROM third GROUP BY 1, 2, 3, 4),
edges AS (SELECT slice, a, b, distance FROM rim WHERE coalesce(low, '-infinity'::DOUBLE) <= coalesce(high, 'infinity'::DOUBLE) + 1e-9 * distance AND coalesce(flat, 0) >= -1e-9 * distance * distance
  UNION ALL SELECT slice, a, b, distance FROM cand WHERE slice IN (SELECT slice FROM gp GROUP BY 1 HAVING count(*) = 2))"""
SPACE = (OBS, COORDINATES)
add("j1_resolve_coordinates", lambda s, d: flows.region_points(src.observations(s, d), src.coordinates(s, d)).select("destination_region", "destination_fias", "lat", "lon", "coordinate_source", "resolved"), RESOLVED + " SELECT destination_region, destination_fias, lat, lon, coordinate_source, resolved FROM pts", "lat lon", SPACE)
add("a27_data_quality", lambda s, d: flows.preview(src.observations(s, d), src.coordinates(s, d)), RESOLVED + """ SELECT destination_region, count(*) AS points, sum(resolved::INT)::BIGINT AS resolved_points, sum(trip_count)::BIGINT AS trips, coalesce(sum(trip_count) FILTER (resolved), 0)::BIGINT AS resolved_trips,
  count(weighted_rub_per_km) AS economic_valid, max(has_forecast) AS has_forecast, max(contains(period_types, ',')::INT) AS mixed_periods, CASE WHEN count(*) > 0 THEN 100.0 * sum(resolved::INT) / count(*) ELSE 0.0 END AS point_coverage_pct,
  CASE WHEN sum(trip_count) > 0 THEN 100.0 * coalesce(sum(trip_count) FILTER (resolved), 0) / sum(trip_count) ELSE 0.0 END AS trip_coverage_pct FROM pts GROUP BY 1""", "point_coverage_pct trip_coverage_pct", SPACE)
add("n17_projection", lambda s, d: _points(s, d).select("slice", "id", F.round(F.col("x") / 1000, 3).alias("x"), F.round(F.col("y") / 1000, 3).alias("y")), PROJECTED + " SELECT slice, id, round(x / 1000, 3) AS x, round(y / 1000, 3) AS y FROM gp", "", SPACE)
add("g1_nearest_distance", lambda s, d: graph.nearest_distance(_points(s, d)), NEAREST + " SELECT slice, id, nearest FROM nn", "nearest", SPACE)
add("g2_adaptive_threshold", lambda s, d: graph.adaptive_threshold(graph.nearest_distance(_points(s, d))), LIMIT + " SELECT slice, threshold FROM lim", "threshold", SPACE)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    points = _points(s, d)
    limit = graph.adaptive_threshold(graph.nearest_distance(points))
    return cut(graph.pairs_within(points.join(limit, "slice"), "threshold"), "pairs")


add("j8_neighbour_pairs", _pairs, LIMIT + " SELECT slice, a, b, distance FROM pw JOIN lim USING (slice) WHERE a < b AND distance > 0 AND distance <= threshold", "distance", SPACE)
add("g3_delaunay_edges", lambda s, d: _edges(s, d)[1], EDGES + " SELECT * FROM edges", "distance", SPACE)
add("g4_mutual_knn", lambda s, d: graph.mutual_knn_edges(_pairs(s, d)), LIMIT + """, near AS (SELECT slice, a, b, distance FROM pw JOIN lim USING (slice) WHERE distance > 0 AND distance <= threshold),
rk AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY slice, a ORDER BY distance, b) <= 5)
SELECT x.slice, x.a, x.b, x.distance FROM rk x JOIN rk y ON x.slice = y.slice AND x.a = y.b AND x.b = y.a WHERE x.a < x.b""", "distance", SPACE)
COMPONENTS = EDGES.replace("WITH", "") + """
, both_ AS (SELECT slice, a, b FROM edges UNION SELECT slice, b, a FROM edges),
reach AS (SELECT DISTINCT slice, a AS id, a AS label FROM both_ UNION SELECT r.slice, e.b, r.label FROM reach r JOIN both_ e ON r.slice = e.slice AND r.id = e.a),
comp AS (SELECT slice, id, min(label) AS component FROM reach GROUP BY 1, 2)"""
add("g5_components", lambda s, d: graph.components(_edges(s, d)[1]), COMPONENTS + " SELECT slice, id, component FROM comp", "", ("RECURSIVE " + OBS.strip(), COORDINATES))


def _isolated(s: SparkSession, d: str) -> DataFrame:
    points, edges, _ = _edges(s, d)
    return graph.isolated(points, edges)


def _audit(s: SparkSession, d: str) -> DataFrame:
    points, edges, _ = _edges(s, d)
    return graph.graph_audit(points, edges, graph.components(edges))


def _zones(mode: str) -> Callable:
    def make(s: SparkSession, d: str) -> DataFrame:
        points, edges, _ = _edges(s, d)
        own = zones.eligible(points, mode)
        how = ("weighted_rub_per_km", "trip_count") if mode == "bear_cost" else ("trip_count", None)
        return zones.high_zones(own, edges, *how)

    return make


def _sensitivity(s: SparkSession, d: str) -> DataFrame:
    points, edges, _ = _edges(s, d)
    return zones.threshold_sensitivity(zones.eligible(points, "bear_cost"), edges)


def _partitions(s: SparkSession, d: str) -> DataFrame:
    points, edges, _ = _edges(s, d)
    own = cut(flows.partition_modes(points, edges), "partitions")
    keyed = lambda df: df.withColumn("slice", F.concat_ws("@", "mode", "slice"))
    table = economics.cluster_table(points.join(own, ["slice", "id"]), ["mode", "slice"])
    modes = own.select("mode").distinct()
    bad = graph.connectivity_violations(keyed(edges.crossJoin(F.broadcast(modes))), keyed(own)).groupBy("slice").agg(F.count("*").alias("violations"))
    bad = bad.select(F.split("slice", "@")[0].alias("mode"), F.split("slice", "@")[1].alias("slice"), "violations")
    return table.join(bad, ["mode", "slice"], "left").na.fill(0, ["violations"])


def _bear_sql(value: str, mean: str, pooled: str, rule: str, keyed: bool = False, end: str | None = None) -> str:
    """keyed: the threshold is part of the slice. end: what to select instead of the zones of each point."""
    eligible = f"SELECT *, 0.35 AS zone FROM gp WHERE {rule}", "SELECT * FROM edges"
    if keyed:
        eligible = tuple(f"SELECT x.* REPLACE (slice || '@' || t AS slice), t::DOUBLE AS zone FROM {x} x, th{' WHERE ' + rule if x == 'gp' else ''}" for x in ("gp", "edges"))
    return COMPONENTS.split(", both_ AS")[0] + f"""
, th AS (SELECT unnest([{', '.join(f"'{x}'" for x in zones.THRESHOLDS)}]) AS t), el AS ({eligible[0]}), ke AS ({eligible[1]}), ba AS (SELECT slice, {mean} AS base FROM el GROUP BY 1),
mk AS (SELECT el.*, CASE WHEN base > 0 THEN {value} / base - 1 END AS delta, base FROM el JOIN ba USING (slice)), ca AS (SELECT * FROM mk WHERE delta >= zone),
ie AS (SELECT e.slice, e.a, e.b FROM ke e JOIN ca p ON p.slice = e.slice AND p.id = e.a JOIN ca q ON q.slice = e.slice AND q.id = e.b),
both_ AS (SELECT slice, a, b FROM ie UNION SELECT slice, b, a FROM ie),
reach AS (SELECT DISTINCT slice, a AS id, a AS label FROM both_ UNION SELECT r.slice, e.b, r.label FROM reach r JOIN both_ e ON r.slice = e.slice AND r.id = e.a),
comp AS (SELECT slice, id, min(label) AS component FROM reach GROUP BY 1, 2),
own AS (SELECT ca.*, component FROM ca LEFT JOIN comp USING (slice, id)),
zo AS (SELECT slice, component FROM own WHERE component IS NOT NULL GROUP BY 1, 2 HAVING {pooled} / any_value(base) - 1 >= any_value(zone)),
fi AS (SELECT slice, id, component AS first_id, 0 AS kind FROM own JOIN zo USING (slice, component) UNION ALL SELECT slice, id, id, 1 FROM own WHERE component IS NULL AND delta >= 0.70),
nu AS (SELECT slice, kind, first_id, row_number() OVER (PARTITION BY slice ORDER BY kind, first_id) - 1 AS cluster_id FROM (SELECT DISTINCT slice, kind, first_id FROM fi)),
found AS (SELECT mk.slice, mk.id, mk.trip_count, mk.delta, coalesce(mk.delta >= mk.zone, false) AS candidate, coalesce(nu.cluster_id, -1)::INT AS cluster_id, CASE fi.kind WHEN 0 THEN 'zone' WHEN 1 THEN 'singleton' END AS cluster_type
FROM mk LEFT JOIN fi USING (slice, id) LEFT JOIN nu ON nu.slice = fi.slice AND nu.kind = fi.kind AND nu.first_id = fi.first_id)
{end or 'SELECT slice, id, delta, candidate, cluster_id, cluster_type FROM found'}"""


RECURSIVE = ("RECURSIVE " + OBS.strip(), COORDINATES)
WR = WMEAN.format(v="weighted_rub_per_km", w="trip_count")
add("g6_isolated_points", _isolated, EDGES + " SELECT slice, id FROM gp WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.slice = gp.slice AND (e.a = gp.id OR e.b = gp.id))", "", SPACE)
add("g9_graph_audit", _audit, COMPONENTS + """, n AS (SELECT slice, count(*) AS nodes FROM gp GROUP BY 1), l AS (SELECT slice, count(*) AS edges, avg(distance) AS mean_edge, quantile_cont(distance, 0.95) AS p95_edge, max(distance) AS max_edge FROM edges GROUP BY 1),
c AS (SELECT slice, count(DISTINCT component) AS parts, count(*) AS linked FROM comp GROUP BY 1)
SELECT slice, nodes, coalesce(edges, 0) AS edges, mean_edge, p95_edge, max_edge, coalesce(parts, 0) + nodes - coalesce(linked, 0) AS components, nodes - coalesce(linked, 0) AS isolated, 2.0 * coalesce(edges, 0) / nodes AS mean_degree FROM n LEFT JOIN l USING (slice) LEFT JOIN c USING (slice)""", "mean_edge p95_edge max_edge mean_degree", RECURSIVE)
add("c11_bear_cost_zones", _zones("bear_cost"), _bear_sql("weighted_rub_per_km", WR, WR, "trip_count > 0 AND weighted_rub_per_km IS NOT NULL"), "delta", RECURSIVE)
add("c12_bear_volume_zones", _zones("bear_volume"), _bear_sql("trip_count", "avg(trip_count)", "avg(trip_count)", "trip_count > 0"), "delta", RECURSIVE)
COST_RULE = "trip_count > 0 AND weighted_rub_per_km IS NOT NULL"
add(
    "c13_threshold_sensitivity",
    _sensitivity,
    _bear_sql("weighted_rub_per_km", WR, WR, COST_RULE, True, """, sz AS (SELECT slice, cluster_id, cluster_type, count(*) AS n, coalesce(sum(trip_count), 0) AS trips, sum(candidate::INT) AS cand FROM found GROUP BY 1, 2, 3)
SELECT regexp_replace(slice, '@[^@]*$', '') AS slice, regexp_extract(slice, '@([^@]*)$', 1)::DOUBLE AS threshold, sum(cand)::BIGINT AS candidates, count(*) FILTER (cluster_type = 'zone') AS zones,
  count(*) FILTER (cluster_type = 'singleton') AS singletons, coalesce(sum(n) FILTER (cluster_id >= 0), 0)::BIGINT AS covered_points, coalesce(sum(trips) FILTER (cluster_id >= 0), 0)::BIGINT AS covered_trips,
  coalesce(avg(n) FILTER (cluster_type = 'zone'), 0) AS mean_zone_size, coalesce(max(n) FILTER (cluster_type = 'zone'), 0) AS max_zone_size FROM sz GROUP BY sz.slice"""),
    "threshold mean_zone_size",
    RECURSIVE,
)
add(
    "p2_point_states",
    lambda s, d: flows.point_states(src.observations(s, d), src.coordinates(s, d), "bear_cost"),
    _bear_sql("weighted_rub_per_km", WR, WR, COST_RULE, False, """, dq AS (SELECT destination_region AS slice, concat_ws(',', CASE WHEN max(has_forecast) > 0 THEN 'CONTAINS_FORECAST' END, CASE WHEN max(contains(period_types, ',')::INT) > 0 THEN 'MIXED_ECONOMIC_SEGMENTS' END,
  CASE WHEN sum(resolved::INT) < count(*) THEN 'COORDINATE_INCOMPLETE' END, CASE WHEN count(weighted_rub_per_km) < count(*) THEN 'ECONOMIC_UNAVAILABLE' END) AS warnings FROM pts GROUP BY 1),
lone AS (SELECT slice, id FROM gp WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.slice = gp.slice AND (e.a = gp.id OR e.b = gp.id)))
SELECT r.destination_region AS slice, r.destination_fias AS id, coalesce(f.cluster_id, -1)::INT AS cluster_id,
  CASE WHEN f.id IS NULL THEN 'unavailable' WHEN f.cluster_id >= 0 THEN f.cluster_type WHEN f.candidate THEN 'candidate' WHEN l.id IS NOT NULL THEN 'spatial_outlier' ELSE 'ordinary' END AS status, warnings
FROM pts r LEFT JOIN found f ON f.slice = r.destination_region AND f.id = r.destination_fias LEFT JOIN lone l ON l.slice = r.destination_region AND l.id = r.destination_fias JOIN dq ON dq.slice = r.destination_region
WHERE r.destination_fias IS NOT NULL"""),
    "",
    RECURSIVE,
)


def _nested(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points, and three nested partitions of them by their numbers."""
    points = _points(s, d)
    k = F.explode(F.array(*[F.lit(n) for n in (2, 4, 8)])).alias("k")
    own = points.select("slice", "id", k).withColumn("cluster_id", (F.substring("id", 2, 20).cast("long") % F.col("k")).cast("int"))
    return points.withColumns({"value": F.col("weighted_rub_per_km"), "weight": F.col("trip_count").cast("double")}), own


QUALITY = "silhouette calinski_harabasz davies_bouldin tiny_share size_cv mean_radius_m p95_radius_m max_radius_m mad selection_score"
add(
    "c5_c6_partition_quality",
    lambda s, d: zones.selection_score(cut(zones.partition_quality(*_nested(s, d)), "quality")),
    PROJECTED + f"""
, asg AS (SELECT gp.*, k, (substr(id, 2)::BIGINT % k)::INT AS c FROM gp, (SELECT unnest([2, 4, 8]) AS k)),
pd AS (SELECT a.slice, a.k, a.id, a.c, b.c AS oc, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS total, count(*) AS n FROM asg a JOIN asg b ON a.slice = b.slice AND a.k = b.k AND a.id <> b.id GROUP BY 1, 2, 3, 4, 5),
ab AS (SELECT slice, k, id, max(total / n) FILTER (c = oc) AS a, min(total / n) FILTER (c <> oc) AS b FROM pd GROUP BY 1, 2, 3),
si AS (SELECT slice, k, CASE WHEN count(a) > 0 THEN avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) END AS silhouette FROM ab GROUP BY 1, 2),
fa AS (SELECT asg.*, coalesce(total, 0) AS total FROM asg LEFT JOIN pd ON pd.slice = asg.slice AND pd.k = asg.k AND pd.id = asg.id AND pd.oc = asg.c),
me AS (SELECT slice, k, c, arg_min(x, (total, id)) AS ox, arg_min(y, (total, id)) AS oy, avg(x) AS mx, avg(y) AS my, count(*) AS n, {WR} AS mv FROM fa GROUP BY 1, 2, 3),
bo AS (SELECT fa.*, mx, my, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS r, sqrt(pow(x - ox, 2) + pow(y - oy, 2)) AS reach, abs(weighted_rub_per_km - mv) AS off_ FROM fa JOIN me USING (slice, k, c)),
ra AS (SELECT slice, k, avg(reach) AS mean_radius_m, quantile_cont(reach, 0.95) AS p95_radius_m, max(reach) AS max_radius_m, {WMEAN.format(v='off_', w='trip_count')} AS mad, avg(x) AS gx, avg(y) AS gy, count(*) AS points FROM bo GROUP BY 1, 2),
sp AS (SELECT slice, k, c, sum(r * r) AS w, avg(r) AS spread FROM bo GROUP BY 1, 2, 3),
ce AS (SELECT * FROM me JOIN sp USING (slice, k, c) JOIN ra USING (slice, k)),
su AS (SELECT slice, k, sum(n * (pow(mx - gx, 2) + pow(my - gy, 2))) / nullif(count(*) - 1, 0) / nullif(sum(w) / nullif(any_value(points) - count(*), 0), 0) AS calinski_harabasz,
  sum((n <= 2)::INT)::BIGINT AS tiny_clusters, avg((n <= 2)::INT) AS tiny_share, stddev_pop(n) / avg(n) AS size_cv, count(*) AS clusters, any_value(points) AS points FROM ce GROUP BY 1, 2),
wo AS (SELECT a.slice, a.k, a.c, max((a.spread + b.spread) / sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2))) AS r FROM ce a JOIN ce b ON a.slice = b.slice AND a.k = b.k AND a.c <> b.c GROUP BY 1, 2, 3),
db AS (SELECT slice, k, avg(r) AS davies_bouldin FROM wo GROUP BY 1, 2),
q AS (SELECT su.*, mean_radius_m, p95_radius_m, max_radius_m, mad, silhouette, CASE WHEN calinski_harabasz IS NOT NULL THEN davies_bouldin END AS davies_bouldin FROM su JOIN ra USING (slice, k) LEFT JOIN si USING (slice, k) LEFT JOIN db USING (slice, k)),
sc AS (SELECT *, min(silhouette) OVER w AS s0, max(silhouette) OVER w AS s1, min(mad) OVER w AS m0, max(mad) OVER w AS m1 FROM q WINDOW w AS (PARTITION BY slice))
SELECT * EXCLUDE (s0, s1, m0, m1), 0.7 * coalesce(CASE WHEN s1 > s0 THEN (coalesce(silhouette, 0) - s0) / (s1 - s0) END, 1) + (1 - 0.7) * coalesce(1 - CASE WHEN m1 > m0 THEN (coalesce(mad, 0) - m0) / (m1 - m0) END, 1) - 0.10 * k / points - 0.20 * tiny_share AS selection_score FROM sc""",
    QUALITY,
    SPACE,
)


def _quarters(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points, and clusters by number; one in five has none."""
    points = _points(s, d)
    n = F.substring("id", 2, 20).cast("long")
    return points, points.select("slice", "id", F.when(n % 5 == 0, -1).otherwise((n % 4).cast("int")).alias("cluster_id"))


QUARTERS = PROJECTED + """
, asg AS (SELECT *, CASE WHEN substr(id, 2)::BIGINT % 5 = 0 THEN -1 ELSE (substr(id, 2)::BIGINT % 4)::INT END AS cluster_id FROM gp)"""
PCT = "coverage_pct noise_pct trip_coverage_pct mean_m weighted_mean_m p95_m weighted_p95_m max_m min_share max_share share_cv"
add(
    "c17_compactness",
    lambda s, d: zones.compactness(*_quarters(s, d)),
    QUARTERS + """
, t AS (SELECT *, greatest(coalesce(trip_count, 0), 0) AS t FROM asg),
far AS (SELECT a.slice, a.cluster_id, a.id, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS far FROM asg a JOIN asg b USING (slice, cluster_id) WHERE a.cluster_id >= 0 GROUP BY 1, 2, 3),
med AS (SELECT slice, cluster_id, arg_min(id, (far, id)) AS medoid FROM far GROUP BY 1, 2),
ow AS (SELECT t.*, sqrt(pow(t.x - m.x, 2) + pow(t.y - m.y, 2)) AS d FROM t JOIN med USING (slice, cluster_id) JOIN gp m ON m.slice = t.slice AND m.id = medoid),
wh AS (SELECT slice, count(*) AS points, count(*) FILTER (cluster_id >= 0) AS assigned, sum(t) AS trips, sum(t) FILTER (cluster_id >= 0) AS own_trips FROM t GROUP BY 1),
re AS (SELECT slice, avg(d) AS mean_m, sum(d * t) / nullif(sum(t), 0) AS weighted_mean_m, quantile_cont(d, 0.95) AS p95_m, max(d) AS max_m FROM ow GROUP BY 1),
ta AS (SELECT slice, min(d) AS weighted_p95_m FROM (SELECT slice, d, sum(t) OVER (PARTITION BY slice ORDER BY d RANGE UNBOUNDED PRECEDING) AS u, sum(t) OVER (PARTITION BY slice) AS w FROM ow WHERE t > 0) WHERE u >= 0.95 * w GROUP BY 1),
cl AS (SELECT slice, cluster_id, count(*) AS n, CASE WHEN any_value(trips) > 0 THEN sum(t) / any_value(trips) ELSE 0 END AS share FROM ow JOIN wh USING (slice) GROUP BY 1, 2),
sh AS (SELECT slice, min(n) AS min_size, max(n) AS max_size, min(share) AS min_share, max(share) AS max_share, coalesce(stddev_pop(share) / nullif(avg(share), 0), 0) AS share_cv FROM cl GROUP BY 1)
SELECT slice, 100.0 * assigned / points AS coverage_pct, 100 - 100.0 * assigned / points AS noise_pct, coalesce(100.0 * own_trips / nullif(trips, 0), 0) AS trip_coverage_pct, mean_m, weighted_mean_m, p95_m, weighted_p95_m, max_m,
  coalesce(min_size, 0) AS min_size, coalesce(max_size, 0) AS max_size, coalesce(min_share, 0) AS min_share, coalesce(max_share, 0) AS max_share, coalesce(share_cv, 0) AS share_cv FROM wh LEFT JOIN re USING (slice) LEFT JOIN ta USING (slice) LEFT JOIN sh USING (slice)""",
    PCT,
    SPACE,
)


# k-means over all combinations at once
KMEANS = {"ks": (2, 3, 4, 5, 6), "seeds": (42, 43, 44), "starts": 2}


def _fits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = _points(s, d)
    return points, cut(kmeans.fits(points, **KMEANS), "kmeans-fits")


add(
    "c14_kmeans_fits",
    lambda s, d: kmeans.fit_check(*_fits(s, d)),
    # whatever the starts: a fit for each combination with enough points, in which no point is nearer to another cluster's mean
    PROJECTED + f"""
, wp AS (SELECT slice, weights, CASE WHEN weights = 'none' THEN 1 ELSE greatest(coalesce(trip_count, 0), 0) END AS w FROM gp, (VALUES ('none'), ('shipment_count')) v(weights)),
size AS (SELECT slice, weights, count(*) AS points, count(*) FILTER (w > 0) AS heavy FROM wp GROUP BY 1, 2)
SELECT slice, CAST(k AS INT) AS k, weights, CAST(seed AS INT) AS seed, points, 0::BIGINT AS not_nearest
FROM size, unnest({list(KMEANS["ks"])}) a(k), unnest({list(KMEANS["seeds"])}) b(seed) WHERE heavy >= k""",
    "",
    SPACE,
)
add("c15_kmeans_sweep", lambda s, d: kmeans.leaderboard(*kmeans.best_runs(_points(s, d), **KMEANS)))


HASHED = ("row_key", "origin_fias", "destination_fias", "period_id", "period_type", "price_type", "trip_count")
add(
    "s17_dataset_hash",
    lambda s, d: scans.dataset_hash(src.observations(s, d), ["destination_region"], list(HASHED)),
    f""", h AS (SELECT destination_region, sha256(concat_ws('|', {", ".join(f"coalesce({c}::VARCHAR, chr(92) || 'N')" for c in HASHED)})) AS h FROM obs),
p AS (SELECT destination_region, count(*) AS n, {", ".join(f"sum(CAST('0x' || substr(h, {15 * k + 1}, 15) AS BIGINT)) AS p{k}" for k in range(4))} FROM h GROUP BY 1)
SELECT destination_region, n AS n_rows, sha256(concat_ws(':', n, p0, p1, p2, p3)) AS dataset_hash FROM p""",
)



# overlapping profiles
PROFILES = [
    pilots.Profile("all of 1", "NATION_1"),
    pilots.Profile("spot of 1", "NATION_1", price_type=("spot",)),
    pilots.Profile("two origins to 1", "NATION_1", ("s1", "s2"), ("retro", "current")),
    pilots.Profile("tents to 2", "NATION_2", vehicle_type=("tent",), tonnage_id=("1", "2", "4")),
    pilots.Profile("forecasts for 3", "NATION_3", period_type=("forecast",)),
    pilots.Profile("one origin to 3", "NATION_3", ("s3",)),
    pilots.Profile("nowhere", "NATION_99"),
]


def _profile_sql(p: pilots.Profile) -> str:
    one_of = lambda c, values: f"{c} IN ({', '.join(repr(v) for v in values)})"
    tests = [f"destination_region = '{p.region}'", "destination_fias IS NOT NULL", *([one_of("origin_fias", p.origins)] if p.origins else []), *[one_of(f, getattr(p, f)) for f in pilots.FILTERS if getattr(p, f)]]
    return f"SELECT '{p.name}' AS slice, destination_fias, {MEASURES} FROM obs WHERE {' AND '.join(tests)} GROUP BY destination_fias"


add(
    "p5_pilot_economics",
    lambda s, d: pilots.merged_economics(pilots.partial_states(src.observations(s, d)), pilots.membership(s, PROFILES)).drop("destination_region", "destination_name"),
    " UNION ALL BY NAME ".join(map(_profile_sql, PROFILES)),
    THREE,
)
add("p5_pilots", lambda s, d: pilots.pilots(src.observations(s, d), src.coordinates(s, d), PROFILES))


# boundaries
def _places(s: SparkSession, d: str) -> DataFrame:
    return src.places(s, d).select(F.col("destination_region").alias("region"), F.col("destination_fias").alias("id"), "lon", "lat")


def _trips(s: SparkSession, d: str) -> DataFrame:
    trips = src.observations(s, d).where("destination_fias is not null").groupBy(F.col("destination_fias").alias("id")).agg(F.sum("trip_count").alias("trip_count"))
    return cut(_places(s, d).join(trips, "id", "left").withColumn("trip_count", F.coalesce("trip_count", F.lit(0))), "places")


OUTLINE = """
pl AS (SELECT destination_region AS region, destination_fias AS id, lon, lat FROM geo),
me AS (SELECT region, avg(lon) AS mx, avg(lat) AS my FROM pl GROUP BY 1),
se AS (SELECT region, CAST(floor((atan2(lat - my, lon - mx) + pi()) * 72 / (2 * pi())) AS INT) AS seq, lon, lat, (lon - mx) * (lon - mx) + (lat - my) * (lat - my) AS r FROM pl JOIN me USING (region)),
vx AS (SELECT region, seq, arg_max(lon, r) AS lon, arg_max(lat, r) AS lat FROM se GROUP BY 1, 2)"""
#: All edges of a region with all of its points.
INSIDE = """
ed AS (SELECT region, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2 FROM vx WINDOW w AS (PARTITION BY region ORDER BY seq)),
hit AS (SELECT p.region, p.id, sum(((y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1))::INT) % 2 = 1 AS odd,
  bool_or(abs((lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)) < 1e-12 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge
  FROM pl p JOIN ed USING (region) GROUP BY 1, 2),
ins AS (SELECT region, id, odd OR edge AS inside FROM hit)"""
add("j9_point_in_boundary", lambda s, d: territory.covered(_places(s, d), src.outline(_places(s, d))).select("region", "id", "inside"), f", {OUTLINE.strip()}, {INSIDE.strip()} SELECT region, id, inside FROM ins")
add(
    "c23_boundary_audit",
    lambda s, d: territory.boundary_audit(_trips(s, d), src.outline(_places(s, d))),
    f""", {OUTLINE.strip()}, {INSIDE.strip()}
, tr AS (SELECT id, inside, region, coalesce(t, 0) AS t FROM ins LEFT JOIN (SELECT destination_fias AS id, sum(trip_count) AS t FROM obs GROUP BY 1) USING (id)),
ar AS (SELECT region, abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * 6371008.8 * 6371008.8 / 2 / 1e6 AS area_km2 FROM ed GROUP BY 1),
bo AS (SELECT region, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM vx GROUP BY 1)
SELECT region, west, south, east, north, area_km2, count(*) AS points, sum(inside::INT)::BIGINT AS points_inside, 100.0 * sum(CASE WHEN inside THEN t ELSE 0 END) / nullif(sum(t), 0) AS trips_inside_pct
FROM tr JOIN ar USING (region) JOIN bo USING (region) GROUP BY 1, 2, 3, 4, 5, 6""",
    "west south east north area_km2 trips_inside_pct",
)
CELL = 40_000.0


def _territory(s: SparkSession, d: str) -> DataFrame:
    points, own = _quarters(s, d)
    ring = cut(src.outline(points.select(F.col("slice").alias("region"), F.col("x").alias("lon"), F.col("y").alias("lat"))), "outline")
    table = zones.summarize(points, own).select("slice", "cluster_id", F.col("medoid").alias("id"))
    medoids = table.join(points.select("slice", "id", "x", "y"), ["slice", "id"]).select(F.col("slice").alias("region"), "cluster_id", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return territory.territory_metrics(ring, cut(territory.territory_grid(ring, medoids, CELL), "territory"), CELL)


add(
    "c22_territory",
    _territory,
    QUARTERS + f"""
, far AS (SELECT a.slice, a.cluster_id, a.id, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS far FROM asg a JOIN asg b USING (slice, cluster_id) WHERE a.cluster_id >= 0 GROUP BY 1, 2, 3),
med AS (SELECT f.slice, f.cluster_id, any_value(g.x) AS mx, any_value(g.y) AS my FROM (SELECT slice, cluster_id, arg_min(id, (far, id)) AS id FROM far GROUP BY 1, 2) f JOIN gp g USING (slice, id) GROUP BY 1, 2),
p0 AS (SELECT slice AS region, x AS lon, y AS lat FROM gp), me AS (SELECT region, avg(lon) AS mx, avg(lat) AS my FROM p0 GROUP BY 1),
se AS (SELECT region, CAST(floor((atan2(lat - my, lon - mx) + pi()) * 72 / (2 * pi())) AS INT) AS seq, lon, lat, (lon - mx) * (lon - mx) + (lat - my) * (lat - my) AS r FROM p0 JOIN me USING (region)),
vx AS (SELECT region, seq, arg_max(lon, r) AS lon, arg_max(lat, r) AS lat FROM se GROUP BY 1, 2),
bx AS (SELECT region, min(lon) AS w, min(lat) AS s, greatest(1, ceil((max(lon) - min(lon)) / {CELL})) AS nx, greatest(1, ceil((max(lat) - min(lat)) / {CELL})) AS ny FROM vx GROUP BY 1),
g1 AS (SELECT *, unnest(range(0, nx::INT)) AS gx FROM bx), g2 AS (SELECT *, unnest(range(0, ny::INT)) AS gy FROM g1),
pl AS (SELECT region, gx || ':' || gy AS id, gx, gy, w + (gx + 0.5::DOUBLE) * {CELL} AS lon, s + (gy + 0.5::DOUBLE) * {CELL} AS lat FROM g2), {INSIDE.strip()},
cd AS (SELECT region, gx, gy, cluster_id, pow(lon - mx, 2) + pow(lat - my, 2) AS d FROM ins JOIN pl USING (region, id) JOIN med ON med.slice = region WHERE inside),
ce AS (SELECT region, gx, gy, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM cd GROUP BY 1, 2, 3),
reach AS (SELECT region, cluster_id, gx, gy, gx AS rx, gy AS ry FROM ce UNION SELECT r.region, r.cluster_id, c.gx, c.gy, r.rx, r.ry FROM reach r JOIN ce c ON c.region = r.region AND c.cluster_id = r.cluster_id AND abs(c.gx - r.gx) + abs(c.gy - r.gy) = 1),
lab AS (SELECT region, cluster_id, gx, gy, min((rx, ry)) AS part FROM reach GROUP BY 1, 2, 3, 4),
zo AS (SELECT region, cluster_id, count(DISTINCT part) AS parts, count(*) AS cells FROM lab GROUP BY 1, 2),
zs AS (SELECT region, count(*) AS zone_count, max(parts) AS max_connected_components, count(*) FILTER (parts > 1) AS fragmented_zone_count, sum(cells) AS cells FROM zo GROUP BY 1),
ar AS (SELECT region, abs(sum(x1 * y2 - x2 * y1) / 2) AS area FROM ed GROUP BY 1)
SELECT region, coalesce(100.0 * coalesce(cells, 0) * {CELL} * {CELL} / nullif(area, 0), 0) AS coverage_pct, 0.0::DOUBLE AS overlap_pct, coalesce(zone_count, 0) AS zone_count, coalesce(max_connected_components, 0) AS max_connected_components,
  coalesce(fragmented_zone_count, 0) AS fragmented_zone_count FROM ar LEFT JOIN zs USING (region)""",
    "coverage_pct overlap_pct",
    RECURSIVE,
)
SPREAD = "slice_mean within_mad within_variance between_variance spread variance_ratio"
for _name, _value, _weight in (("c9_cost_spread", "weighted_rub_per_km", "trip_count"), ("c10_volume_spread", "trip_count", None)):
    _w = _weight or "1"
    add(
        _name,
        lambda s, d, v=_value, w=_weight: zones.spread_metrics(*_quarters(s, d), v, w),
        QUARTERS + f"""
, p AS (SELECT slice, cluster_id, ({_value})::DOUBLE AS v, ({_w})::DOUBLE AS w FROM asg),
cl AS (SELECT slice, cluster_id, {WMEAN.format(v='v', w='w')} AS m, {'sum(w)' if _weight else '1.0'} AS cw FROM p WHERE cluster_id >= 0 GROUP BY 1, 2),
wh AS (SELECT slice, {WMEAN.format(v='v', w='w')} AS slice_mean FROM p GROUP BY 1),
i AS (SELECT p.slice, {WMEAN.format(v='abs(v - m)', w='w')} AS within_mad, {WMEAN.format(v='pow(v - m, 2)', w='w')} AS within_variance FROM p JOIN cl USING (slice, cluster_id) GROUP BY 1),
b AS (SELECT slice, {WMEAN.format(v='pow(m - slice_mean, 2)', w='cw')} AS between_variance, max(m) - min(m) AS spread FROM cl JOIN wh USING (slice) GROUP BY 1)
SELECT slice, slice_mean, within_mad, within_variance, between_variance, spread, CASE WHEN within_variance > 1e-9 THEN between_variance / within_variance END AS variance_ratio FROM wh JOIN i USING (slice) JOIN b USING (slice)""",
        SPREAD,
        SPACE,
    )
SWEEP = LIMIT.split(",\nlim AS")[0] + f""", mu AS (SELECT unnest([{', '.join(f"'{m}'" for m in flows.MULTIPLIERS)}]) AS mt),
lims AS (SELECT slice, mt, mt::DOUBLE AS multiplier, CASE WHEN mad > 0 THEN m + mt::DOUBLE * 1.4826 * mad ELSE mt::DOUBLE * m END AS threshold FROM mad, mu),
lim AS (SELECT slice, max(threshold) AS threshold FROM lims GROUP BY 1)""" + EDGES.split("AS threshold FROM mad)")[1]
add(
    "g10_pruning_sensitivity",
    lambda s, d: flows.pruning_sensitivity(_points(s, d)),
    SWEEP + """, kept AS (SELECT e.slice || '@' || mt AS slice, a, b, distance FROM edges e JOIN lims USING (slice) WHERE distance <= lims.threshold),
both_ AS (SELECT slice, a, b FROM kept UNION SELECT slice, b, a FROM kept),
reach AS (SELECT DISTINCT slice, a AS id, a AS label FROM both_ UNION SELECT r.slice, e.b, r.label FROM reach r JOIN both_ e ON r.slice = e.slice AND r.id = e.a),
comp AS (SELECT slice, id, min(label) AS component FROM reach GROUP BY 1, 2),
n AS (SELECT slice, mt, multiplier, threshold, slice || '@' || mt AS key, count(*) AS nodes FROM gp JOIN lims USING (slice) GROUP BY 1, 2, 3, 4),
l AS (SELECT slice AS key, count(*) AS edges, avg(distance) AS mean_edge, quantile_cont(distance, 0.95) AS p95_edge, max(distance) AS max_edge FROM kept GROUP BY 1),
c AS (SELECT slice AS key, count(DISTINCT component) AS parts, count(*) AS linked FROM comp GROUP BY 1),
au AS (SELECT slice, multiplier, threshold, coalesce(parts, 0) + nodes - coalesce(linked, 0) AS components, nodes - coalesce(linked, 0) AS isolated, coalesce(edges, 0) AS edges, mean_edge, p95_edge, max_edge FROM n LEFT JOIN l USING (key) LEFT JOIN c USING (key))
SELECT *, components - lag(components) OVER (PARTITION BY slice ORDER BY multiplier) AS components_delta FROM au""",
    "multiplier threshold mean_edge p95_edge max_edge",
    RECURSIVE,
)
add(
    "g11_method_comparison",
    lambda s, d: flows.method_comparison(_points(s, d)),
    EDGES + """
, near AS (SELECT slice, a, b, distance FROM pw JOIN lim USING (slice) WHERE distance > 0 AND distance <= threshold),
rk AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY slice, a ORDER BY distance, b) <= 5),
kept AS (SELECT 'delaunay' AS method, slice, a, b, distance FROM edges
  UNION ALL SELECT 'mutual_knn', x.slice, x.a, x.b, x.distance FROM rk x JOIN rk y ON x.slice = y.slice AND x.a = y.b AND x.b = y.a WHERE x.a < x.b),
both_ AS (SELECT method, slice, a, b FROM kept UNION SELECT method, slice, b, a FROM kept),
reach AS (SELECT DISTINCT method, slice, a AS id, a AS label FROM both_ UNION SELECT r.method, r.slice, e.b, r.label FROM reach r JOIN both_ e ON r.method = e.method AND r.slice = e.slice AND r.id = e.a),
comp AS (SELECT method, slice, id, min(label) AS component FROM reach GROUP BY 1, 2, 3),
n AS (SELECT method, slice, count(*) AS nodes FROM gp, (VALUES ('delaunay'), ('mutual_knn')) v(method) GROUP BY 1, 2),
l AS (SELECT method, slice, count(*) AS edges, avg(distance) AS mean_edge, quantile_cont(distance, 0.95) AS p95_edge, max(distance) AS max_edge FROM kept GROUP BY 1, 2),
c AS (SELECT method, slice, count(DISTINCT component) AS parts, count(*) AS linked FROM comp GROUP BY 1, 2)
SELECT method, slice, nodes, coalesce(edges, 0) AS edges, mean_edge, p95_edge, max_edge, coalesce(parts, 0) + nodes - coalesce(linked, 0) AS components, nodes - coalesce(linked, 0) AS isolated,
  2.0 * coalesce(edges, 0) / nodes AS mean_degree FROM n LEFT JOIN l USING (method, slice) LEFT JOIN c USING (method, slice)""",
    "mean_edge p95_edge max_edge mean_degree",
    RECURSIVE,
)


def _partition_checks(s: SparkSession, d: str) -> DataFrame:
    """Per mode and region: eligible points, those in a cluster, and clusters that do not hang together on the eligible points' graph."""
    points, edges, _ = _edges(s, d)
    found = cut(flows.partition_modes(points, edges), "partitions")
    key = F.concat_ws("@", "mode", "slice").alias("slice")
    links = edges.crossJoin(F.broadcast(found.select("mode").distinct()))  # three modes
    torn = graph.connectivity_violations(links.select(key, "a", "b", "distance"), found.select(key, "id", "cluster_id"))
    torn = torn.groupBy(F.col("slice").alias("run")).agg(F.count("*").alias("violations"))
    out = found.groupBy("mode", "slice").agg(F.count("*").alias("points"), F.count_if(F.col("cluster_id") >= 0).alias("clustered"))
    return out.join(torn, F.concat_ws("@", "mode", "slice") == F.col("run"), "left").select("mode", "slice", "points", "clustered", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))


add(
    "c8_partition_checks",
    _partition_checks,
    # whatever K is chosen: a point is in a cluster if and only if it has an edge to an eligible one, and every cluster hangs together
    EDGES + """
, el AS (SELECT mode, slice, id FROM gp, (VALUES ('geography'), ('geo_cost'), ('geo_volume')) v(mode) WHERE mode <> 'geo_cost' OR (trip_count > 0 AND weighted_price IS NOT NULL AND weighted_rub_per_km IS NOT NULL)),
ie AS (SELECT x.mode, x.slice, e.a, e.b FROM edges e JOIN el x ON x.slice = e.slice AND x.id = e.a JOIN el y ON y.mode = x.mode AND y.slice = e.slice AND y.id = e.b),
lk AS (SELECT mode, slice, a AS id FROM ie UNION SELECT mode, slice, b FROM ie)
SELECT mode, slice, count(*) AS points, count(lk.id) AS clustered, 0::BIGINT AS violations FROM el LEFT JOIN lk USING (mode, slice, id) GROUP BY 1, 2""",
    "",
    SPACE,
)
add("c8_c9_c10_partition_modes", _partitions)
add("p3_compare", lambda s, d: flows.compare(src.observations(s, d), src.coordinates(s, d)))


def _summaries(s: SparkSession, d: str) -> DataFrame:
    points = _points(s, d)
    return zones.summarize(points, points.select("slice", "id", (F.substring("id", 2, 20).cast("long") % 4).cast("int").alias("cluster_id")))


add("c16_summaries", _summaries, PROJECTED + f"""
, asg AS (SELECT *, (substr(id, 2)::BIGINT % 4)::INT AS cluster_id FROM gp),
far AS (SELECT a.slice, a.cluster_id, a.id, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS far FROM asg a JOIN asg b USING (slice, cluster_id) GROUP BY 1, 2, 3),
med AS (SELECT slice, cluster_id, arg_min(id, (far, id)) AS medoid FROM far GROUP BY 1, 2),
rr AS (SELECT a.*, medoid, sqrt(pow(a.x - m.x, 2) + pow(a.y - m.y, 2)) / 1000 AS r FROM asg a JOIN med USING (slice, cluster_id) JOIN gp m ON m.slice = a.slice AND m.id = medoid)
SELECT slice, cluster_id, medoid, count(*) AS points, sum(trip_count)::BIGINT AS trips, avg(x) AS centroid_x, avg(y) AS centroid_y, {WMEAN.format(v='weighted_price', w='trip_count')} AS weighted_price, {WR} AS weighted_rub_per_km,
  avg(r) AS mean_radius_km, quantile_cont(r, 0.95) AS p95_radius_km, max(r) AS max_radius_km, count(*) / (SELECT count(*) FROM gp g WHERE g.slice = rr.slice)::DOUBLE AS point_share FROM rr GROUP BY 1, 2, 3""", "centroid_x centroid_y weighted_price weighted_rub_per_km mean_radius_km p95_radius_km max_radius_km point_share", SPACE)
add("w2_weighted_percentile", lambda s, d: zones.weighted_percentile(src.observations(s, d).where("price > 0"), ["destination_region"], "price", "trip_count", 0.9), """, g AS (SELECT destination_region, price, sum(trip_count) AS w FROM obs WHERE price > 0 AND trip_count > 0 GROUP BY 1, 2),
u AS (SELECT *, sum(w) OVER (PARTITION BY destination_region ORDER BY price) AS u, sum(w) OVER (PARTITION BY destination_region) AS t FROM g) SELECT destination_region, min(price) AS weighted_percentile FROM u WHERE u >= 0.9 * t GROUP BY 1""", "weighted_percentile")


def _clustered(s: SparkSession, d: str) -> DataFrame:
    snapshots = cut(src.actual_snapshots(s, d), "snapshots")
    return flows.evaluation_rows(src.observations(s, d), snapshots, src.origin_mapping(s, d), src.distances(s, d), None, src.assignments(snapshots))


CLUSTERED = DATASET + """
, asg AS (SELECT DISTINCT shipment_month, actual_origin_id, destination_region, substr(actual_origin_id, 2)::INT AS n, substr(shipment_month, 6, 2)::INT AS mo FROM act WHERE substr(actual_origin_id, 2)::INT % 3 <> 0),
cv AS (SELECT ev.*, asg.n IS NOT NULL AS clustered, CASE WHEN (asg.n + mo) % 5 <> 0 THEN 900.0 + 10 * mo + asg.n END AS e2, CASE WHEN (asg.n + mo) % 5 <> 0 THEN (1.5 + mo / 10.0) * distance_km END AS e3 FROM ev LEFT JOIN asg USING (shipment_month, actual_origin_id, destination_region)),
pred AS (SELECT shipment_month, actual_origin_id, destination_region, actual_price, qty, unnest([{'v': 'E0', 'p': pulse_price}, {'v': 'E1', 'p': pulse_rub_per_km * distance_km}, {'v': 'E2', 'p': e2}, {'v': 'E3', 'p': e3}], recursive := true) FROM cv),
ok AS (SELECT *, v AS variant, p AS predicted, 100 * abs(p - actual_price) / actual_price AS ape FROM pred WHERE actual_price > 0 AND qty > 0 AND p IS NOT NULL)"""
add("e1_cluster_variants", lambda s, d: evaluation.metrics(evaluation.predictions(_clustered(s, d)).where(F.col("variant").isin("E0", "E1", "E2", "E3")), ["variant"]), CLUSTERED + f" SELECT variant, {METRICS} FROM ok GROUP BY 1", MD, EVAL)
add("j3_clustered_dataset", lambda s, d: _clustered(s, d).groupBy("cluster_status", "origin_status").agg(F.count("*").alias("cells"), F.countDistinct("cluster_id").alias("clusters")), CLUSTERED + " SELECT CASE WHEN clustered THEN 'matched' ELSE 'missing' END AS cluster_status, origin_status, count(*) AS cells, count(DISTINCT CASE WHEN clustered THEN (SELECT mo % 4 FROM asg a WHERE a.shipment_month = cv.shipment_month AND a.actual_origin_id = cv.actual_origin_id AND a.destination_region = cv.destination_region) END) AS clusters FROM cv GROUP BY 1, 2", "", EVAL)


def _centres(s: SparkSession, d: str) -> DataFrame:
    """Centres of the regions whose name has an even length; the others have none."""
    return src.places(s, d).where(F.length("destination_region") % 2 == 0).groupBy(F.col("destination_region").alias("region")).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


CENTRES = """, cent AS (SELECT destination_region AS region, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM geo WHERE length(destination_region) % 2 = 0 GROUP BY 1)"""
TOWNS = """, sides AS (SELECT DISTINCT 'origin' AS side, origin_name AS town, origin_region AS region FROM obs UNION SELECT DISTINCT 'destination', destination_name, destination_region FROM obs WHERE destination_name IS NOT NULL),
towns AS (SELECT DISTINCT town, region, CASE WHEN starts_with(town, 'г ') THEN substr(town, 3) ELSE town END AS short FROM sides)"""
LOCATED = CENTRES + TOWNS + """
, loc AS (SELECT t.town, t.region, CASE WHEN e.name IS NOT NULL THEN coalesce(e.lat, c.lat) WHEN n.name IS NOT NULL THEN coalesce(n.lat, c.lat) ELSE c.lat END AS lat,
  CASE WHEN e.name IS NOT NULL THEN coalesce(e.lon, c.lon) WHEN n.name IS NOT NULL THEN coalesce(n.lon, c.lon) ELSE c.lon END AS lon,
  CASE WHEN e.lat IS NOT NULL THEN 'exact' WHEN e.name IS NULL AND n.lat IS NOT NULL THEN 'normalized' WHEN c.lat IS NOT NULL THEN 'centre' ELSE 'missing' END AS source
  FROM towns t LEFT JOIN coords e ON e.name = t.town AND e.region = t.region LEFT JOIN coords n ON n.name = t.short AND n.region = t.region LEFT JOIN cent c ON c.region = t.region)"""


def _towns_of(s: SparkSession, d: str) -> DataFrame:
    return townmap.towns_of(src.observations(s, d)).select("town", "region").distinct()


add("j2_centre_fallback", lambda s, d: townmap.resolve_with_centre(_towns_of(s, d), src.coordinates(s, d), _centres(s, d)), LOCATED + " SELECT town, region, lat, lon, source FROM loc", "lat lon", SPACE)
add(
    "a30_town_coverage",
    lambda s, d: townmap.town_coverage(src.observations(s, d), src.coordinates(s, d), _centres(s, d)),
    LOCATED + """ SELECT count(*) AS towns, count(lat) AS geocoded, count(*) - count(lat) AS missing, (SELECT count(*) FROM sides WHERE side = 'origin') AS origin_towns, (SELECT count(*) FROM sides WHERE side = 'destination') AS destination_towns FROM loc""",
    "",
    SPACE,
)
FROM_TO = (["FRANCE", "BRAZIL", "CHINA", "NATION_1", "NATION_2", "NATION_3"], ["GERMANY", "INDIA", "PERU", "NATION_4", "NATION_5", "NATION_6", "NATION_7"])
_in = lambda names: ", ".join(f"'{x}'" for x in names)
add(
    "f3_map_points",
    lambda s, d: townmap.map_points(src.observations(s, d), *FROM_TO),
    f", r AS (SELECT * FROM obs WHERE origin_region IN ({_in(FROM_TO[0])}) AND destination_region IN ({_in(FROM_TO[1])})) SELECT 'origin' AS side, origin_name AS town, origin_region AS region, {MEASURES} FROM r GROUP BY 2, 3 UNION ALL SELECT 'destination', destination_name, destination_region, {MEASURES} FROM r GROUP BY 2, 3",
    THREE,
)
add(
    "f4_town_records",
    lambda s, d: townmap.town_records(src.observations(s, d), "destination", "Customer#000000001", src.places(s, d).where("c_custkey = 1").first().destination_region, period_type=["Retro", "CURRENT"]).select("row_key", "origin_fias", "period_type", "price"),
    "SELECT row_key, origin_fias, period_type, price FROM obs WHERE destination_name = 'Customer#000000001' AND destination_region = (SELECT destination_region FROM geo WHERE c_custkey = 1) AND period_type IN ('retro', 'current')",
    "price",
)


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Stored coordinates, of which some villages have their region's centre."""
    p = src.places(s, d).join(_centres(s, d).select(F.col("region").alias("destination_region"), F.col("lat").alias("clat"), F.col("lon").alias("clon")), "destination_region", "left")
    k, village = F.col("c_custkey"), F.col("c_custkey") % 5 == 0
    at = lambda c: F.when(k % 10 < 6, F.col(f"c{c}")).otherwise(F.col(c)).alias(c)
    return p.select(F.when(village, F.concat(F.lit("с "), F.col("c_name"))).otherwise(F.col("c_name")).alias("name"), F.col("destination_region").alias("region"), at("lat"), at("lon"))


add(
    "f12_without_centres",
    lambda s, d: townmap.without_centre_coordinates(_stored(s, d), _centres(s, d)),
    CENTRES + """, st AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'с ' || c_name ELSE c_name END AS name, destination_region AS region, CASE WHEN c_custkey % 10 < 6 THEN cent.lat ELSE geo.lat END AS lat, CASE WHEN c_custkey % 10 < 6 THEN cent.lon ELSE geo.lon END AS lon
  FROM geo LEFT JOIN cent ON cent.region = destination_region)
SELECT * FROM st WHERE NOT (starts_with(name, 'с ') AND EXISTS (SELECT 1 FROM cent WHERE cent.lat = st.lat AND cent.lon = st.lon))""",
    "lat lon",
)
add(
    "f13_backfilled_keys",
    lambda s, d: townmap.backfill_keys(_towns_of(s, d), src.coordinates(s, d), src.places(s, d).where("c_custkey % 3 != 0").select(F.col("c_name").alias("name"), "lat", "lon")),
    TOWNS + """, old AS (SELECT c_name AS name, lat, lon FROM geo WHERE c_custkey % 3 <> 0)
SELECT t.town, t.region, coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon FROM towns t LEFT JOIN old a ON a.name = t.town LEFT JOIN old b ON b.name = t.short
WHERE NOT EXISTS (SELECT 1 FROM coords c WHERE c.name = t.town AND c.region = t.region) AND coalesce(a.lat, b.lat) IS NOT NULL""",
    "lat lon",
    SPACE,
)
add("f2_baseline_filter", lambda s, d: economics.baseline_filter(src.observations(s, d), period_type="current", price_type="tender").groupBy("origin_fias").agg(*economics.metric_aggregates()), f"SELECT origin_fias, {MEASURES} FROM obs WHERE period_type = 'current' AND price_type = 'tender' GROUP BY 1", THREE)
add("n15_source_row_id", lambda s, d: src.observations(s, d).select("row_key", scalars.source_row_id(F.lit("2024-01"), F.col("row_key")).alias("source_row_id")), "SELECT row_key, substr(sha256('2024-01:' || row_key), 1, 16) AS source_row_id FROM obs")
_spread = lambda c, n: f"min({c}) AS {n}_least, " + ", ".join(f"quantile_cont({c}, {q}) AS {n}_p{round(100 * q)}" for q in (0.5, 0.75, 0.95, 0.99)) + f", max({c}) AS {n}_greatest"
add(
    "a15_data_audit",
    lambda s, d: economics.data_audit(economics.destination_economics(src.observations(s, d), ["destination_region"]), ["destination_region"]),
    f""", routes AS ({destinations_sql('destination_region')}), m AS (SELECT destination_region, {WMEAN.format(v='weighted_rub_per_km', w='trip_count')} AS mean_rate FROM routes GROUP BY 1)
SELECT destination_region, mean_rate, sum(trip_count)::DOUBLE AS trips, {_spread('trip_count::DOUBLE', 'trips')}, {_spread('weighted_rub_per_km', 'rate')},
  {', '.join(f'count(*) FILTER (coalesce(CASE WHEN mean_rate > 0 THEN weighted_rub_per_km / mean_rate - 1 END, 0) >= {x}) AS above_{round(100 * x)}' for x in (0.2, 0.25, 0.3, 0.35, 0.4, 0.5))},
  count(*) FILTER (coalesce(trip_count, 0) <= 0) AS without_trips, count(*) FILTER (weighted_rub_per_km IS NULL) AS without_rate FROM routes JOIN m USING (destination_region) GROUP BY 1, 2""",
    "mean_rate trips " + " ".join(f"{n}_{x}" for n in ("trips", "rate") for x in ("least", "p50", "p75", "p95", "p99", "greatest")),
)
add(
    "a29_origin_match_summary",
    lambda s, d: evaluation.origin_match_summary(src.origin_mapping(s, d), evaluation.ground_truth(src.actual_snapshots(s, d))),
    TRUTH + """, o AS (SELECT actual_origin_id, sum(greatest(coalesce(qty_total, 0), 0)) AS q, count(*) AS n FROM truth GROUP BY 1), h AS (SELECT o.*, coalesce(match_status = 'matched', false) AS hit FROM o LEFT JOIN mapping USING (actual_origin_id)),
c AS (SELECT coalesce(sum(q) FILTER (hit) / sum(q), 0) AS matched_qty, coalesce(sum(n) FILTER (hit) / sum(n), 0) AS matched_cells FROM h)
SELECT count(*) AS origins, count(*) FILTER (match_status = 'matched') AS matched, count(*) FILTER (match_status = 'ambiguous') AS ambiguous, count(*) FILTER (match_status = 'unmatched') AS unmatched, any_value(matched_qty) AS matched_qty, any_value(matched_cells) AS matched_cells FROM mapping, c""",
    "matched_qty matched_cells",
    EVAL,
)
add(
    "u3_assignment_coverage",
    lambda s, d: zones.assignment_coverage(_points(s, d).where(F.length("id") != 3), _points(s, d).where("id not like '%7'")),
    PROJECTED + " SELECT slice, (count(*) FILTER (length(id) <> 3 AND id LIKE '%7'))::BIGINT AS missing, (count(*) FILTER (length(id) = 3 AND id NOT LIKE '%7'))::BIGINT AS extra FROM gp WHERE length(id) <> 3 OR id NOT LIKE '%7' GROUP BY 1",
    "",
    SPACE,
)


def _by_period(s: SparkSession, d: str) -> DataFrame:
    """Destinations of each kind of period, in classes by their rate and by their trips."""
    rows = economics.destination_economics(src.observations(s, d), ["period_type"])
    rate, trips = F.floor(F.col("weighted_rub_per_km") / 40).cast("int"), (F.col("trip_count") % 3).cast("int")
    own = [rows.select(F.lit(m).alias("mode"), F.col("period_type").alias("slice"), F.col("destination_fias").alias("id"), F.coalesce(c, F.lit(-1)).alias("cluster_id")) for m, c in (("rate", rate), ("trips", trips))]
    return own[0].union(own[1])


PERIODS = f""", routes AS ({destinations_sql('period_type')}), asg AS (SELECT 'rate' AS mode, period_type AS slice, destination_fias AS id, coalesce(floor(weighted_rub_per_km / 40)::INT, -1) AS c FROM routes UNION ALL SELECT 'trips', period_type, destination_fias, (trip_count % 3)::INT FROM routes)"""
add(
    "c21_slice_stability",
    lambda s, d: zones.slice_stability(_by_period(s, d)),
    PERIODS + """, b AS (SELECT x.mode, x.slice AS left_slice, y.slice AS right_slice, x.c AS l, y.c AS r FROM asg x JOIN asg y ON x.mode = y.mode AND x.id = y.id AND x.slice < y.slice WHERE x.c >= 0 AND y.c >= 0),
ce AS (SELECT mode, left_slice, right_slice, l, r, count(*)::DOUBLE AS n FROM b GROUP BY ALL), le AS (SELECT mode, left_slice, right_slice, l, sum(n) AS n FROM ce GROUP BY ALL), ri AS (SELECT mode, left_slice, right_slice, r, sum(n) AS n FROM ce GROUP BY ALL),
a AS (SELECT mode, left_slice, right_slice, sum(n) AS n, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS e FROM ce GROUP BY ALL), la AS (SELECT mode, left_slice, right_slice, sum(n * (n - 1) / 2) AS pl, sum(n * ln(n)) AS el FROM le GROUP BY ALL), ra AS (SELECT mode, left_slice, right_slice, sum(n * (n - 1) / 2) AS pr, sum(n * ln(n)) AS er FROM ri GROUP BY ALL),
f AS (SELECT *, pl * pr / (n * (n - 1) / 2) AS ex, (pl + pr) / 2 AS best, ln(n) - el / n AS hl, ln(n) - er / n AS hr, ln(n) - e / n AS h FROM a JOIN la USING (mode, left_slice, right_slice) JOIN ra USING (mode, left_slice, right_slice))
SELECT mode, left_slice, right_slice, n AS points, CASE WHEN best = ex THEN 1.0 ELSE (p - ex) / (best - ex) END AS ari, CASE WHEN (hl + hr) / 2 <= 1e-12 THEN 1.0 ELSE (hl + hr - h) / ((hl + hr) / 2) END AS nmi FROM f""",
    "points ari nmi",
)
add("c21_candidate_recurrence", lambda s, d: zones.candidate_recurrence(_by_period(s, d)), PERIODS + ", t AS (SELECT mode, count(DISTINCT slice) AS s FROM asg GROUP BY 1) SELECT mode, id, count(DISTINCT slice) / any_value(s) AS share FROM asg JOIN t USING (mode) WHERE c >= 0 GROUP BY 1, 2", "share")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in QUERIES.items() if (sql := q.oracle()) is not None}
