"""Rendezvous sharding against xxhash in Python, and its laws."""

import math
import zlib

import xxhash
from pyspark.sql import functions as F

from textlake.llm import sharding


def winner(key, weights):
    def score(i, w):
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little") , seed=xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42))
        return -w / math.log(((h >> 11) + 0.5) * 2.0**-53) if w > 0 else -1.0

    return max((score(i, w), i) for i, w in enumerate(weights))


def test_laws(spark):
    docs = spark.createDataFrame([(i, "é" * (i % 5) if i % 7 else None, "x") for i in range(3000)] + [(5, "again", "y"), (None, "z", "z"), (None, "z", "z")], "doc_id long, text string, shard string")
    out = sharding.shards(docs).collect()
    assert len(out) == 3003
    for r in out:
        best, shard = winner(r.doc_id or 0, [1.0] * 40)
        assert r.shard == shard and r.grown_shard in (shard, 40)
        assert r.grown_shard == winner(r.doc_id or 0, [1.0] * 41)[1]
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 20 < sum(r.grown_shard == 40 for r in out) < 150
    one = next(r for r in out if r.doc_id == 8)
    assert one.size == 16 + 6 and one.text_crc32 == zlib.crc32("ééé".encode()) and one.law == "key"
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == 7} == {(16, 0)}


def test_weights_and_empty(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = {r.shard: r.n for r in sharding.shards(docs, (1.0, 3.0, 0.0)).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert 2 not in n and 2.6 < n[1] / n[0] < 3.4
    assert sharding.shards(docs.limit(0)).count() == 0
