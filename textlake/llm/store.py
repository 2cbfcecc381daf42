"""Shared scratch tables, size-checked joins and Arrow batch limits for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import drop_at_exit, release, scratch_path, shared_dir

__all__ = ["drop_at_exit", "filter_rows", "keyed_join", "limit_batches", "materialise", "release", "scratch_path", "shared_dir"]

#: A side of a join is broadcast up to this many rows of one or two longs (32 MB of keys).
BROADCAST_ROWS = 1_000_000
#: What a broadcast table of known bytes holds at most.
BROADCAST_BYTES = 16 << 20
#: Narrow rows that one task writes easily.
TASK_ROWS = 100_000
#: Arrow batches: rows and bytes at most.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20

def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage and survives lost executors.

    rows: what df holds at most, of narrow rows, if known; it is then written by no more tasks than that takes, as
    a file costs more than thousands of such rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def limit_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch holds, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def filter_rows(docs: DataFrame, keeper: Callable[[str], Callable]) -> DataFrame:
    """The rows of docs that an Arrow filter leaves; keeper(name of the text column) makes it. Columns get plain names on the way, as dots in names don't pass."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(keeper(f"c{docs.columns.index('text')}"), plain.schema).toDF(*docs.columns)


def keyed_join(df: DataFrame, keys: DataFrame, on: str | list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join with a narrow key table: broadcast if it is counted and small enough, else a shuffled join."""
    rows = keys.count() if rows is None else rows
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on, how)
