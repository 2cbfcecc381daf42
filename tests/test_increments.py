"""Batch after batch: stored bands, ingest by hash buckets, state that expires."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textlake.operators import dedup, near_index
from textlake.operators.near_index import NearIndex
from textlake.streaming import ingest


def corpus():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"]) + str(rng.randrange(40)) for _ in range(40)) for _ in range(30)]
    rows = []
    for k in range(120):
        t = texts[rng.randrange(30)]
        rows.append((k, t if rng.random() < 0.4 else t.replace("alpha", "alpa", rng.randrange(3)) + " x" * rng.randrange(3)))
    return [*rows, (120, "short"), (121, "short"), (122, None), (123, "")]


@pytest.mark.parametrize("finish", [0, 1_000_000])
def test_batches_give_the_marks_of_one_run(spark, tmp_path, finish):
    docs = spark.createDataFrame([(*r, "x") for r in corpus()], "doc_id long, text string, band string")
    want = sorted(map(tuple, dedup.greedy_marks(docs).collect()))
    index = NearIndex(spark, f"file://{tmp_path}/bands")
    got = []
    for k in range(2):
        batch = docs.where((F.col("doc_id") >= 62 * k) & (F.col("doc_id") < 62 * (k + 1)))
        marks = sorted(map(tuple, index.add(batch, k, finish=finish).collect()))
        # a batch that runs again gives and stores the same
        before = index.stored().count()
        assert sorted(map(tuple, index.add(batch, k, finish=finish).collect())) == marks and index.stored().count() == before
        got += marks
    assert sorted(got) == want and sum(m for _, m in want) > 20
    assert index.add(docs.limit(0), 9).count() == 0
    rows = docs.limit(3).select("doc_id", F.lit(5).cast("long").alias("band"), F.lit(5).alias("bucket"))
    plan = index.colliding(rows, 77)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "signature" not in plan


def test_ingest_reads_the_buckets_of_a_batch_only(spark, tmp_path, sample_text):
    rows = [(i, f"{sample_text} {i % 7}", "en") for i in range(20)] + [(99, "bad", "en")]
    for k in range(4):
        spark.createDataFrame(rows[k::4], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    schema = "doc_id long, text string, lang string"
    for _ in range(2):
        ingest.ingest(ingest.stream_documents(spark, f"file://{tmp_path}/in/*", schema), out, mark, min_words=20).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 7 == got.select("content_hash").distinct().count()
    # a lost checkpoint replays all batches, which add nothing
    ingest.ingest(ingest.stream_documents(spark, f"file://{tmp_path}/in/*", schema), out, f"{mark}2", min_words=20).awaitTermination()
    assert spark.read.parquet(out).count() == 7
    batch = spark.read.parquet(out).limit(1).select("content_hash", "bucket")
    plan = ingest.unseen(spark.createDataFrame(batch.collect(), batch.schema), out, 50)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]


def test_state_expires(spark, tmp_path):
    schema = "doc_id long, content_hash string, created_at timestamp"
    day = lambda d: dt.datetime(2024, 5, 1) + dt.timedelta(days=d)
    seen = []

    def run(k, rows):
        """A file, and the stream restarted from its checkpoint; rows of state left."""
        spark.createDataFrame([(i, h, day(d)) for i, h, d in rows], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = ingest.first_within(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*"), "2 days")
        q = stream.writeStream.foreachBatch(lambda b, _: seen.extend(sorted(r.doc_id for r in b.collect()))).option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress.stateOperators[0].numRowsTotal

    run(0, [(1, "a", 0), (2, "b", 0)])
    assert run(1, [(3, "a", 1), (4, "c", 1)]) == 3 and seen == [1, 2, 4]
    left = run(2, [(5, "d", 9)])  # the stream's time passes what came before
    assert seen == [1, 2, 4, 5] and left < 3
    run(3, [(6, "a", 9), (7, "d", 9)])
    assert seen == [1, 2, 4, 5, 6]


def test_code_pages(spark):
    from textlake.functions import text as T

    texts = ["naïve café — “quoted” €5", "日本語のテキスト", "plain ascii", "Ünïcödé ÄÖ", "Â", None, "", "Ã©tude", "š Ÿ œ"]
    wrong = [t if t is None else t.encode().decode("latin-1").translate(T.WINDOWS) for t in texts]
    rows = spark.createDataFrame([(k, t, w) for k, (t, w) in enumerate(zip(texts, wrong, strict=True))], "k int, text string, wrong string")
    out = rows.select("text", T.unmojibake(F.col("wrong")).alias("back"), T.unmojibake(F.col("text")).alias("same")).collect()
    for r in out:
        assert r.same == (r.text if r.text != "Ã©tude" else "étude")
        assert r.back == r.same


def test_a_batch_that_lies_in_one_file_is_signed_by_all_tasks(spark, tmp_path, monkeypatch):
    docs, dealt, old = spark.createDataFrame(corpus(), "doc_id long, text string").coalesce(1), [], near_index.banded
    monkeypatch.setattr(near_index, "banded", lambda texts, kind: (dealt.append(texts.rdd.getNumPartitions()), old(texts, kind))[1])
    marks = NearIndex(spark, f"file://{tmp_path}/bands").add(docs, 0)
    assert sorted(map(tuple, marks.collect())) == sorted(map(tuple, dedup.greedy_marks(docs).collect()))
    assert dealt == [spark.sparkContext.defaultParallelism] and dealt[0] > 1
