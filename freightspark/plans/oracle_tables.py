"""The stand-in tables of sources/standins.py as DuckDB common table expressions."""

OBS = """
geo AS (
  SELECT c_custkey, 'c' || c_custkey AS destination_fias, c_name, n_name AS destination_region, r_name AS continent,
    50.0::DOUBLE + ((c_custkey * c_custkey * 31 + c_custkey * 7919) % 10007)::DOUBLE / 2000.0::DOUBLE AS lat,
    30.0::DOUBLE + ((c_custkey * c_custkey * 17 + c_custkey * 104729) % 10009)::DOUBLE / 1000.0::DOUBLE AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
obs AS (
  SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber || '-' || lpad(l_partkey::VARCHAR, 12, '0') || '-' || lpad(l_suppkey::VARCHAR, 12, '0') AS row_key,
    's' || s_suppkey AS origin_fias, s_name AS origin_name, sn.n_name AS origin_region, sn.n_nationkey AS origin_nation,
    CASE WHEN l_orderkey % 97 <> 0 THEN g.destination_fias END AS destination_fias,
    CASE WHEN c_custkey % 23 = 0 THEN 'г ' || c_name ELSE c_name END AS destination_name,
    g.destination_region, g.continent, strftime(l_shipdate, '%Y%m') AS period_id,
    CASE l_returnflag WHEN 'R' THEN 'retro' WHEN 'A' THEN 'current' ELSE 'forecast' END AS period_type,
    CASE l_linestatus WHEN 'O' THEN 'spot' ELSE 'tender' END AS price_type,
    CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice END AS price,
    CASE WHEN l_orderkey % 37 = 0 THEN NULL WHEN l_orderkey % 59 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE + 120.0::DOUBLE * ((lat - 50) + (lon - 30) / 2.0::DOUBLE) END AS route_length,
    CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_orderkey % 61 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS trip_count,
    ['tent', 'ref', 'open'][l_linenumber % 3 + 1] AS vehicle_type, l_linenumber::VARCHAR AS tonnage_id, o_orderdate AS tech_ts,
    CASE WHEN l_partkey % 29 <> 0 THEN ['high', 'medium', 'low'][(l_orderkey + l_linenumber) % 3 + 1] END AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN geo g ON o_custkey = g.c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
)"""

COORDINATES = """
coords AS (
  SELECT c_name AS name, destination_region AS region, CASE WHEN c_custkey % 19 <> 0 THEN lat END AS lat, CASE WHEN c_custkey % 19 <> 0 THEN lon END AS lon
  FROM geo WHERE c_custkey % 17 <> 0
)"""

ACTUAL = """
act0 AS (
  SELECT date_trunc('month', l_shipdate) AS m, CAST(3 - l_orderkey % 7 AS INT) AS horizon, 'a' || s_nationkey AS actual_origin_id, continent AS destination_region,
    l_quantity, l_extendedprice, l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN geo g ON o_custkey = g.c_custkey JOIN supplier ON l_suppkey = s_suppkey
),
act AS (
  SELECT strftime(m - to_months(horizon), '%Y-%m') AS snapshot_month, strftime(m, '%Y-%m') AS shipment_month, horizon, actual_origin_id, destination_region,
    sum(l_quantity) AS qty_total, round(avg(l_discount) * 10, 9) AS auction_percent,
    CASE WHEN horizon < 2 THEN sum(l_extendedprice * (1 - l_discount)) END AS fact_rub_total,
    CASE WHEN horizon < 2 THEN sum(l_extendedprice * (1 - l_discount)) END / sum(l_quantity) AS fact_rub_per_item,
    sum(l_extendedprice) / sum(l_quantity) AS market_rub_per_item
  FROM act0 GROUP BY m, horizon, actual_origin_id, destination_region
)"""

MAPPING = """
mapping AS (
  SELECT 'a' || s_nationkey AS actual_origin_id, 's' || min(s_suppkey) AS origin_fias, CASE WHEN s_nationkey % 5 = 0 THEN 'ambiguous' ELSE 'matched' END AS match_status, s_nationkey AS nation
  FROM supplier GROUP BY s_nationkey
),
dist AS (
  SELECT origin_fias, r_name AS destination_region, NULL::VARCHAR AS shipment_month, (500 + 10 * nation)::DOUBLE AS distance_km FROM mapping, region
  UNION ALL SELECT origin_fias, r_name, NULL, (510 + 10 * nation)::DOUBLE FROM mapping, region WHERE nation % 7 = 0
  UNION ALL SELECT origin_fias, r_name, '1997-01', (490 + 10 * nation)::DOUBLE FROM mapping, region
)"""
