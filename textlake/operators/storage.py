"""Tables with insert-or-replace and deletes, without a table format: a new version is written, then the pointer moves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TOP_K


def upsert(stored: DataFrame, batch: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows of batch replace stored rows of the same key."""
    return stored.join(batch.select(key), key, "left_anti").select(*stored.columns).unionByName(batch.select(*stored.columns))


def delete(stored: DataFrame, gone: DataFrame, key: str = "vec_id") -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def delete_document(documents: DataFrame, chunks: DataFrame, points: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents, their chunks and their points."""
    of = ids.select(F.col("doc_id"))
    return tuple(t.join(of, "doc_id", "left_anti") for t in (documents, chunks, points))


def with_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunks in order."""
    own = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    return documents.join(own, "doc_id", "left")


def page(rows: DataFrame, offset: int = 0, limit: int = TOP_K, newest: str = "created_at", key: str = "doc_id", **equal) -> DataFrame:
    """Rows that equal the given values, newest first."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc_nulls_last(newest), key).offset(offset).limit(limit)


def get(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of that key; raises if there is none."""
    found = rows.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise KeyError(f"no row has {key} = {value!r}")
    return found


class Collection:
    """A versioned Parquet table below a path that Spark writes: create, exists, read, upsert, delete."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.key, self.partition_by = spark, path.rstrip("/"), key, partition_by

    def _pointer(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        at, fs = self._pointer()
        return fs.exists(at)

    def current(self) -> str:
        return self.spark.read.text(f"{self.path}/CURRENT").first().value

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.current()}")

    def replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{version}")
        at, fs = self._pointer()
        out = fs.create(at, True)
        out.write(bytearray(version.encode()))
        out.close()

    def create(self, rows: DataFrame) -> None:
        if not self.exists():
            self.replace(rows)

    def upsert(self, batch: DataFrame) -> None:
        self.replace(upsert(self.read(), batch, self.key) if self.exists() else batch)

    def delete(self, gone: DataFrame) -> None:
        self.replace(delete(self.read(), gone, self.key))
