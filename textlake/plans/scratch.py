"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one below the warehouse, if that is shared: on one machine, or not a local file system."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) and _found(spark, at)[1].getUri().getScheme() == "file":
            raise RuntimeError("executors do not share the warehouse, a local folder: set spark.checkpoint.dir to one that they share")
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _found(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Let the file system delete a folder when the driver ends."""
    at, fs = _found(spark, path)
    fs.deleteOnExit(at)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors, keeps statistics and pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            at, fs = _found(df.sparkSession, path)
            fs.delete(at, True)
