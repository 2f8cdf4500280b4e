"""Writers: tables, flat reports and the input digests beside them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(path, its file system) of the cluster's storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside the path to write to: it becomes the path if the block ends, and goes if it raises. Refuses a path that exists."""
    target, fs = hadoop_path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    work = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    at, _ = hadoop_path(spark, work)
    try:
        yield work
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(at, target):
            raise FileExistsError(path)
    finally:
        if fs.exists(at):
            fs.delete(at, True)


def write_checked(marked: DataFrame, path: str, rules: tuple[str, ...], strict: bool = False) -> dict[str, int]:
    """Rows with an array `errors` as two tables, accepted and rejected, and how many broke each rule: one pass over the input.

    The counts come with the write (an observation), so nothing is read twice. strict: any reject refuses all, with the counts.
    """
    seen = Observation()
    bad = F.size("errors") > 0
    counts = [F.count_if(F.array_contains("errors", r)).alias(r) for r in rules]
    watched = marked.observe(seen, F.count("*").alias("rows"), F.count_if(bad).alias("rejected"), *counts)
    with staged(marked.sparkSession, path) as work:
        watched.withColumn("verdict", F.when(bad, "rejected").otherwise("accepted")).write.partitionBy("verdict").parquet(work)
        found = {k: int(v) for k, v in seen.get.items()}
        if strict and found["rejected"]:
            raise ValueError(f"{found['rejected']} of {found['rows']} rows break a rule: {', '.join(f'{r} {found[r]}' for r in rules if found[r])}")
    return found


def flat_report(report: DataFrame, section: str) -> DataFrame:
    """One row of figures as long (section, metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in report.columns])
    return report.select(F.lit(section).alias("section"), F.inline(pairs))


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, JSON or CSV; arrays become comma-joined text in CSV. Refuses to write over a path that exists."""
    if form == "csv":
        df = df.select(*[F.array_join(f.name, ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema])
    writer = df.write.mode("errorifexists").partitionBy(*partition_by)
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form in ("parquet", "json"):
        getattr(writer, form)(path)
    else:
        raise ValueError(f"no form {form}")


def write_with_report(df: DataFrame, report: DataFrame, path: str, form: str = "parquet") -> None:
    """A table and its audit report side by side."""
    write_table(df, f"{path}/table", form)
    write_table(report, f"{path}/report", "json")


def baseline_rows(baseline: DataFrame) -> DataFrame:
    """Grouping-set rows as long rows of one dimension each: overall, period, origin or destination, and its value."""
    sides = ("period_id", "origin_fias", "destination_fias")
    dimension = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in zip(sides, ("period", "origin", "destination"), strict=True)], F.lit("overall"))
    return baseline.select(dimension.alias("dimension"), F.coalesce(*sides, F.lit("all")).alias("value"), *[c for c in baseline.columns if c not in sides])


#: The columns of the evaluation file in order.
EVALUATION_COLUMNS = (
    "shipment_month", "actual_origin_id", "destination_region", "fact_rub_per_item", "qty_total", "pulse_price", "pulse_trip_weighted_price", "pulse_rub_per_km",
    "pulse_trip_weighted_rub_per_km", "market_rub_per_item", "distance_km", "distance_status", "cluster_id", "mapping_status", "temporal_status", "target_status", "target_horizon",
)
#: What they are called in the rows of evaluation.evaluation_dataset, where that differs.
EVALUATION_NAMES = {
    "fact_rub_per_item": "actual_price", "qty_total": "qty", "pulse_trip_weighted_rub_per_km": "pulse_weighted_rub_per_km", "mapping_status": "origin_status",
    "target_status": "truth_status", "target_horizon": "horizon",
}


def evaluation_file(rows: DataFrame) -> DataFrame:
    """The evaluation rows in the file's columns."""
    return rows.select(*[F.col(EVALUATION_NAMES.get(c, c)).alias(c) for c in EVALUATION_COLUMNS])


def write_baseline(baseline: DataFrame, path: str) -> None:
    write_table(baseline_rows(baseline), path, "csv")


def write_evaluation(rows: DataFrame, predictions: DataFrame, leaderboard: DataFrame, horizons: DataFrame, path: str) -> None:
    """Four CSV tables below the path: rows, predictions, leaderboard and by_horizon."""
    for name, df in (("rows", evaluation_file(rows)), ("predictions", predictions), ("leaderboard", leaderboard), ("by_horizon", horizons)):
        write_table(df, f"{path}/{name}", "csv")
