"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder where none is set, as in local tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("freightspark.shared.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="freightspark-")
        spark.conf.set("freightspark.shared.dir", known)
    return known.rstrip("/")


def cut(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and it is computed once.

    replaces: a table from here that nothing else reads; it is deleted once the new one is complete.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/freightspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        discard(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() has written."""
    if path := getattr(df, "_cut_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
