"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

The shard of a key is the one with the highest score -weight / ln(u), u a uniform hash of key and shard; so the shard
depends on the key and the shards alone, and a new shard takes rows only into itself. Slots number each
shard's rows from 0: a shard is cut into BUCKETS by hash, buckets are counted, and a row's slot is its place in the bucket plus the
sizes of the buckets before it, so no shard is ever sorted in one task.

Defined results: null texts count no bytes and have crc32 0; rows that repeat an id go to the same shard under different slots;
rows with a null id share one key. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash buckets that a shard's rows are numbered in.
BUCKETS = 4096
#: What a record takes besides its text.
RECORD_BYTES = 16


def score(key: Column, shard: Column, weight: Column) -> Column:
    """The rendezvous score of a key for a shard; a weight of 0 or less never wins."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return F.when(weight > 0, -weight / F.log(u)).otherwise(F.lit(-1.0))


def best(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, shard) of the winning shard."""
    table = F.array(*(F.lit(float(w)) for w in weights))
    return F.array_max(F.transform(table, lambda w, i: F.struct(score(key, i.cast("int"), w).alias("score"), i.cast("int").alias("shard"))))


def shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every row of docs."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    text = F.coalesce(F.col("text"), F.lit(""))
    place = docs.withColumn("_key", key).withColumn("_best", best(F.col("_key"), weights)).withColumn("_bucket", F.pmod(F.xxhash64("_key", F.lit("slot")), F.lit(BUCKETS)).cast("int"))
    more = len(weights)
    rows = place.select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.col("_best.shard").alias("shard"),
        F.when(score(F.col("_key"), F.lit(more), F.lit(float(new_weight))) > F.col("_best.score"), F.lit(more)).otherwise(F.col("_best.shard")).alias("grown_shard"),
        "_bucket",
    )
    counted = place.groupBy(F.col("_best.shard").alias("shard"), "_bucket").agg(F.count("*").alias("_n"))  # shards x BUCKETS rows at most
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("_at", F.row_number().over(inside) - 1).join(base, ["shard", "_bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_base") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
