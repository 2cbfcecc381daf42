"""Continuous ingest: file streams of documents into a table, each text once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from ..plans.scratch import materialise, release

#: Hexadecimal digits of the content hash that name a bucket of the table.
PREFIX = 2


def stream_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_texts(docs: DataFrame) -> DataFrame:
    """Each text once over the stream's life, by state on its hash."""
    return docs.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["content_hash"])


def first_within(docs: DataFrame, ttl: str = "7 days", key: str = "content_hash", at: str = "created_at") -> DataFrame:
    """Rows of a stream whose key (hash of a text, url of a crawl's visit) was not seen within `ttl` of their time `at`.

    The state keeps a key until the stream's time is `ttl` past it, so it holds what came within that time, however long the stream runs.
    """
    return docs.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def bucket(content_hash: str = "content_hash") -> F.Column:
    """The folder of a hash: a letter first, so that it is read back as a string."""
    return F.concat(F.lit("h"), F.substring(content_hash, 1, PREFIX))


def unseen(batch: DataFrame, path: str, epoch: int) -> DataFrame:
    """Rows of a batch (content_hash, bucket, ...) that the table lacks, but for what the same epoch wrote; only the batch's buckets are read."""
    spark = batch.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return batch
    buckets = [r.bucket for r in batch.select("bucket").distinct().collect()]  # 16 ** PREFIX at most
    stored = spark.read.schema("content_hash string, bucket string, epoch long").parquet(path)
    stored = stored.where(F.col("bucket").isin(buckets) & (F.col("epoch") != epoch)).select("bucket", "content_hash")
    return batch.join(stored, ["bucket", "content_hash"], "left_anti")


def ingest(docs: DataFrame, path: str, checkpoint: str, **limits):
    """Clean, filter and add new texts to the Parquet table at path, in folders by hash prefix and epoch; a batch that runs again replaces what it wrote.

    Returns the running query, which ends when all files are read.
    """
    kept = cleaning.pipeline(docs, **limits).withColumn("content_hash", F.sha2("text", 256)).withColumn("bucket", bucket())

    def write(batch: DataFrame, epoch: int) -> None:
        batch = materialise(batch, "batch")
        first = batch.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
        new = unseen(batch.join(first, ["content_hash", "doc_id"], "left_semi").dropDuplicates(["content_hash"]), path, epoch)
        new = new.withColumn("epoch", F.lit(epoch).cast("long")).repartition("bucket")
        new.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "epoch").parquet(path)
        release(batch)

    return kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, for streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
