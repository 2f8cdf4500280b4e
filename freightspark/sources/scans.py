"""Readers of the feed's files: observations, snapshots, dimensions, coordinates and boundaries.

Text columns are read as strings under an explicit schema and typed by functions/scalars.py. A header without a
required column is refused before any job. Files whose quoted fields hold line breaks do not split, so ingest once
to Parquet and work from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightspark.functions import scalars as s

#: Columns of the observation feed in order; those marked are required.
OBSERVATION_COLUMNS = (
    "shipment_point_locality_fias_id", "shipment_point_region", "shipment_point_town_source", "shipment_point_name_town", "shipment_point_point_type", "shipment_point_address",
    "delivery_point_locality_fias_id", "delivery_point_region_source", "delivery_point_region_unified", "delivery_point_town", "delivery_point_address", "delivery_point_point_type",
    "period_id", "period_type", "bid_count", "confidence", "nanos", "units", "price_type", "route_length", "route_type", "tonnage_id", "vehicle_body_type", "currency", "tech_load_ts",
)
REQUIRED = frozenset(("shipment_point_locality_fias_id", "shipment_point_region", "delivery_point_locality_fias_id", "delivery_point_region_unified", "delivery_point_town", "period_id", "period_type", "bid_count", "units", "price_type", "route_length"))
DISTANCE_SOURCES = ("internal_actual", "approved_route_system", "manual_verified")


def read_text_table(spark: SparkSession, path: str, required: frozenset[str] | set[str]) -> DataFrame:
    """A CSV file with a header, all columns text; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """The feed's columns with null markers cleaned and nothing typed; absent optional columns are null."""
    df = read_text_table(spark, path, REQUIRED)
    return df.select(*[(s.clean_text(F.col(c)) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in OBSERVATION_COLUMNS])


def scan_observations(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Typed observations with the list of fields that have a value which does not parse."""
    df = read_text_table(spark, path, REQUIRED)
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    text = lambda c: s.clean_text(have(c))
    out = df.select(
        text("shipment_point_locality_fias_id").alias("origin_fias"), text("shipment_point_name_town").alias("origin_name"), text("shipment_point_region").alias("origin_region"),
        text("delivery_point_locality_fias_id").alias("destination_fias"), text("delivery_point_town").alias("destination_name"), text("delivery_point_region_unified").alias("destination_region"),
        text("period_id").alias("period_id"), text("period_type").alias("period_type"), text("price_type").alias("price_type"), text("confidence").alias("confidence"), text("currency").alias("currency"),
        s.parse_float(have("units")).alias("price"), s.parse_float(have("route_length")).alias("route_length"), s.parse_int(have("bid_count")).alias("trip_count"), s.parse_int(have("nanos")).alias("nanos"),
        text("vehicle_body_type").alias("vehicle_type"), text("tonnage_id").alias("tonnage_id"), s.parse_datetime(have("tech_load_ts")).alias("tech_ts"),
        s.validation_errors(have("units"), have("route_length"), have("bid_count"), have("nanos"), have("period_id"), have("tech_load_ts")).alias("validation_errors"),
    )
    return out if limit is None else out.limit(limit)


def scan_evaluation_observations(spark: SparkSession, path: str) -> DataFrame:
    """The narrow projection that price cells need; the reader prunes the rest."""
    return scan_observations(spark, path).select("origin_fias", "origin_name", "destination_region", "destination_fias", "period_id", "period_type", "price_type", "price", "route_length", "trip_count", "nanos", "tech_ts")


def scan_distances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with errors): regions normalised, distances positive, sources approved."""
    df = read_text_table(spark, path, {"origin_fias", "destination_region", "distance_km", "source"})
    month = s.parse_month(F.col("shipment_month")) if "shipment_month" in df.columns else F.lit(None).cast("string")
    out = df.select(s.clean_text(F.col("origin_fias")).alias("origin_fias"), s.normalize_region(F.col("destination_region")).alias("destination_region"), month.alias("shipment_month"), s.parse_float(F.col("distance_km")).alias("distance_km"), s.clean_text(F.col("source")).alias("source"))
    bad = F.array_compact(F.array(F.when(F.col("origin_fias").isNull() | F.col("destination_region").isNull(), "missing_key"), F.when(~F.coalesce(F.col("distance_km") > 0, F.lit(False)), "distance_not_positive"), F.when(~F.coalesce(F.col("source").isin(*DISTANCE_SOURCES), F.lit(False)), "source_not_approved")))
    out = out.withColumn("errors", bad)
    return out.where("size(errors) = 0").drop("errors"), out.where("size(errors) > 0")


def scan_internal_trips(spark: SparkSession, path: str) -> DataFrame:
    df = read_text_table(spark, path, {"origin_fias", "destination_region", "period_id", "route_length", "trip_count"})
    price = s.parse_float(F.col("reference_price")) if "reference_price" in df.columns else F.lit(None).cast("double")
    return df.select(s.clean_text(F.col("origin_fias")).alias("origin_fias"), s.clean_text(F.col("destination_region")).alias("destination_region"), s.clean_text(F.col("period_id")).alias("period_id"), s.parse_float(F.col("route_length")).alias("route_length"), s.parse_int(F.col("trip_count")).alias("trip_count"), price.alias("reference_price"))


def _unique(df: DataFrame, key: list[str]) -> DataFrame:
    """The table itself, refused if a key repeats or is null."""
    n = df.groupBy(*key).agg(F.count("*").alias("n")).where(" or ".join(["n > 1", *[f"{k} is null" for k in key]])).count()
    if n:
        raise ValueError(f"{n} keys of {', '.join(key)} are null or repeat")
    return df


#: Columns of the snapshot file in order; all are required.
SNAPSHOT_COLUMNS = (
    "current_month", "shipment_date_month", "month_label", "shipment_point_name", "shipment_point_name_town", "delivery_point_name", "qty_total", "net_weight_total", "qty_auction",
    "auction_percent", "fact_rub_total", "market_rub_total", "fact_rub_per_item", "market_rub_per_item", "market_spread", "tech_load_ts", "filename", "tech_load_ts_core",
)


def scan_actual_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Typed snapshots of realised prices; label_ok: the month's label is that of the horizon. Rules are evaluation.check_snapshots."""
    df = read_text_table(spark, path, set(SNAPSHOT_COLUMNS))
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    text, number = (lambda c: s.clean_text(have(c))), (lambda c: s.parse_float(have(c)))
    months = df.select("*", s.parse_month(have("current_month")).alias("snapshot_month"), s.parse_month(have("shipment_date_month")).alias("shipment_month"))
    horizon = s.month_difference(F.col("shipment_month"), F.col("snapshot_month"))
    return months.select(
        "snapshot_month", "shipment_month", horizon.alias("horizon"), (F.coalesce(text("month_label"), F.lit("")) == s.month_label(horizon)).alias("label_ok"),
        s.stable_origin_id(text("shipment_point_name")).alias("actual_origin_id"), text("shipment_point_name").alias("origin_name"), text("shipment_point_name_town").alias("origin_town"),
        s.normalize_region(have("delivery_point_name")).alias("destination_region"), *[number(c).alias(c) for c in SNAPSHOT_COLUMNS[6:15]],
        text("tech_load_ts").alias("tech_load_ts"), text("filename").alias("source_filename"), text("tech_load_ts_core").alias("source_loaded_at"),
    )


def scan_origin_mapping(spark: SparkSession, path: str) -> DataFrame:
    df = read_text_table(spark, path, {"actual_origin_id", "pulse_origin_fias"})
    default = lambda c, v: F.coalesce(s.clean_text(F.col(c)) if c in df.columns else F.lit(None), F.lit(v)).alias(c)
    return _unique(df.select(s.clean_text(F.col("actual_origin_id")).alias("actual_origin_id"), s.clean_text(F.col("pulse_origin_fias")).alias("origin_fias"), default("match_method", "manual"), default("match_status", "unmatched"), default("confidence", "unknown")), ["actual_origin_id"])


def scan_cluster_assignments(spark: SparkSession, path: str) -> DataFrame:
    key = ["shipment_month", "actual_origin_id", "destination_region"]
    df = read_text_table(spark, path, {*key, "cluster_id"})
    number = lambda c: (s.parse_float(F.col(c)) if c in df.columns else F.lit(None).cast("double")).alias(c)
    place = s.clean_text(F.col("destination_fias")) if "destination_fias" in df.columns else F.lit(None).cast("string")
    return _unique(df.select(s.parse_month(F.col(key[0])).alias(key[0]), s.clean_text(F.col(key[1])).alias(key[1]), s.normalize_region(F.col(key[2])).alias(key[2]), place.alias("destination_fias"), s.parse_int(F.col("cluster_id")).alias("cluster_id"), number("cluster_price"), number("cluster_rub_per_km")), key)


def scan_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object "name::region" -> [lat, lon] or null; a pair outside the globe counts as no pair."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("key", "pair"))
    name = F.split("key", "::", 2)
    ok = (F.size("pair") == 2) & F.get("pair", F.lit(0)).between(-90, 90) & F.get("pair", F.lit(1)).between(-180, 180)
    good = F.coalesce(ok, F.lit(False))
    return rows.select(name[0].alias("name"), F.get(name, F.lit(1)).alias("region"), F.when(good, F.get("pair", F.lit(0))).alias("lat"), F.when(good, F.get("pair", F.lit(1))).alias("lon"))


GEOMETRY = "struct<type: string, coordinates: string>"


#: Properties that may name a feature, in order.
NAME_FIELDS = ("name", "NAME", "region", "region_name", "subject", "subject_name")


def scan_boundary(spark: SparkSession, path: str, region: str | None = None, fields: tuple[str, ...] = NAME_FIELDS) -> DataFrame:
    """(region, ring, seq, lon, lat) vertices of a GeoJSON boundary; all parts of the matching features make one region.

    A file of several features needs a region, matched by normalised name over the given properties.
    """
    feature = f"struct<properties: map<string, string>, geometry: {GEOMETRY}>"
    whole = spark.read.text(path, wholetext=True).select("value", F.from_json("value", f"struct<type: string, features: array<{feature}>, properties: map<string, string>, geometry: {GEOMETRY}, coordinates: string>").alias("j"))
    kind = F.col("j.type")
    lone = F.struct(F.col("j.properties").alias("properties"), F.when(kind == "Feature", F.col("j.geometry")).otherwise(F.struct(kind.alias("type"), F.col("j.coordinates").alias("coordinates"))).alias("geometry"))
    rows = whole.select(F.explode(F.when(kind == "FeatureCollection", F.col("j.features")).otherwise(F.array(lone))).alias("f"))
    if rows.count() > 1 and region is None:
        raise ValueError("the file has several features: name one")
    if region is not None:
        named = F.array(*[s.normalize_name(F.col("f.properties")[c]) for c in fields])
        rows = rows.where(F.array_contains(F.array_compact(named), s.normalize_name(F.lit(region))))
    single, several = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.from_json("f.geometry.coordinates", single)).otherwise(F.flatten(F.from_json("f.geometry.coordinates", several)))
    parts = rows.select(F.monotonically_increasing_id().alias("part"), F.posexplode(rings).alias("k", "ring"))
    out = parts.select(F.lit(region or "").alias("region"), F.concat_ws("-", "part", "k").alias("ring"), F.posexplode("ring").alias("seq", "v"))
    out = out.select("region", "ring", "seq", F.col("v")[0].alias("lon"), F.col("v")[1].alias("lat"))
    worst = out.agg(F.count("*").alias("n"), F.max(F.abs("lon")).alias("lon"), F.max(F.abs("lat")).alias("lat")).first()
    if not worst.n or worst.lon > 180 or worst.lat > 90:
        raise ValueError("no such region, or coordinates that are not longitude and latitude")
    return out


def rows_digest(columns: list[Column]) -> list[Column]:
    """Aggregates (n, part1..part4) over rows that do not depend on their order: sums of the parts of each row's digest."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]), 256)
    part = lambda k: F.conv(F.substring(row, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("n"), *[F.sum(part(k)).alias(f"part{k + 1}") for k in range(4)]]


def dataset_hash(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., n_rows, dataset_hash): equal for the same rows in any order and partitioning, repeated rows counted."""
    parts = df.groupBy(*by).agg(*rows_digest([F.col(c) for c in columns]))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "part1", "part2", "part3", "part4")])
    return parts.select(*by, F.col("n").alias("n_rows"), F.sha2(text, 256).alias("dataset_hash"))


def data_snapshot(df: DataFrame) -> str:
    """A token of the files that a table is read from: paths, sizes and times as the reader itself sees them, no content."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return dataset_hash(files, [], ["file_path", "file_size", "file_modification_time"]).first()["dataset_hash"]


def demand_snapshot(df: DataFrame, token: str) -> DataFrame:
    """The table, refused if its files are not those that the token was taken from."""
    if (now := data_snapshot(df)) != token:
        raise ValueError(f"the data has changed: snapshot {now[:12]} instead of {token[:12]}")
    return df


def input_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Digest, size and time of each input file. Contents are read: a file is one row of a task."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


#: Entries of a boundary's manifest that must be there, and that may be.
MANIFEST_REQUIRED = ("region", "authority", "source_type", "retrieved_at", "crs", "sha256")


def scan_manifest(spark: SparkSession, path: str, boundary_path: str, require_official: bool = False) -> dict[str, object]:
    """The boundary's manifest (one small JSON object), refused unless its digest is that of the boundary file."""
    fields = (*MANIFEST_REQUIRED, "effective_date", "status")
    schema = ", ".join(f"{c} string" for c in fields) + ", official boolean"
    found = spark.read.schema(schema).json(path, multiLine=True).first()
    if found is None or (missing := [c for c in MANIFEST_REQUIRED if not found[c]]):
        raise ValueError(f"the manifest lacks {', '.join(MANIFEST_REQUIRED if found is None else missing)}")
    own = input_provenance(spark, boundary_path).select("sha256").first()[0]
    if found["sha256"].lower() != own:
        raise ValueError("the manifest is of another boundary file")
    official = bool(found["official"])
    if require_official and not official:
        raise ValueError("the boundary is not official")
    return found.asDict() | {"official": official}
