"""Near-duplicates of what is stored: an index of the bands of kept documents, batch after batch.

A batch gives the marks that one run of the greedy pass over all documents so far would give, if batches come in order of doc_id: a
document is a duplicate if it shares a band with a kept one of an earlier batch; the others are decided among
themselves. Signatures are computed once and not kept: the table holds (band, doc_id) of kept documents, in BUCKETS folders by band, and a batch reads the
folders of its bands only. A batch that runs again under its number replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialise, release
from .dedup import FINISH, MIN_CHARS, banded, collisions

BUCKETS = 32
#: Bands of a batch, as longs, that are broadcast at most; of a larger batch they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


class NearIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def stored(self) -> DataFrame | None:
        """(band, doc_id, batch, bucket) of the kept documents; None before the first batch."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema("band long, doc_id long, batch long, bucket int").parquet(self.path)

    def colliding(self, rows: DataFrame, number: int) -> DataFrame | None:
        """doc_id of the rows (doc_id, band, bucket) that share a band with a document kept by another batch."""
        kept = self.stored()
        if kept is None:
            return None
        buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        bands = rows.select("bucket", "band").distinct()
        near = kept.where(F.col("bucket").isin(buckets) & (F.col("batch") != number)).select("bucket", "band")
        # the stored side stays where it is while the batch's bands fit a broadcast
        small = rows.count() <= BROADCAST_ROWS
        met = near.join(F.broadcast(bands) if small else bands, ["bucket", "band"], "left_semi").distinct()
        return rows.join(met, ["bucket", "band"], "left_semi").select("doc_id").distinct()

    def add(self, docs: DataFrame, number: int, kind: str = "char", min_chars: int = MIN_CHARS, finish: int = FINISH) -> DataFrame:
        """doc_id and is_duplicate of every row of a batch, whose kept documents are stored under its number."""
        texts = docs.where(F.length("text") >= min_chars).select("doc_id", "text")
        # a batch by doc_id often lies in few files, whose tasks would sign it alone
        spread = texts.repartition(max(self.spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions()))
        signed = materialise(banded(spread, kind), "signed")
        rows = signed.select("doc_id", F.explode("bands").alias("band")).withColumn("bucket", F.pmod("band", F.lit(BUCKETS)).cast("int"))
        seen = self.colliding(rows, number)
        gone = None if seen is None else materialise(seen, "seen")
        fresh = signed if gone is None else materialise(signed.join(gone, "doc_id", "left_anti"), "fresh")
        own = materialise(collisions(fresh, finish), "own")
        kept = rows.join(own if gone is None else own.unionByName(gone), "doc_id", "left_anti").withColumn("batch", F.lit(number).cast("long"))
        out = kept.distinct().repartition("bucket").sortWithinPartitions("bucket", "band")
        out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch", "bucket").parquet(self.path)
        marks = (own if gone is None else own.unionByName(gone)).withColumn("is_duplicate", F.lit(True))
        done = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(marks, "doc_id", "left").select("doc_id", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"))
        release(None if gone is None else fresh)
        return done
