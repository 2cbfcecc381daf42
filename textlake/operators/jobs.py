"""Job log, feedback statistics and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MIN_PAIRS, NEGATIVE_SCORE, POSITIVE_SCORE
from ..functions import text as T

STATUSES = ("pending", "running", "success", "failed", "retrying", "cancelled")


def latest(events: DataFrame, key: str = "job_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The state of every job after its last event, by partial aggregation."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_last"), F.count("*").alias("n_events")).select(key, "_last.*", "n_events")


def progress(processed: str = "processed", total: str = "total") -> F.Column:
    """Percent, 99 at most until the job ends; 0 without a total."""
    return F.when(F.col(total) > 0, F.least(F.lit(99), F.floor(F.col(processed) / F.col(total) * 100))).otherwise(F.lit(0)).cast("int")


def feedback_stats(logs: DataFrame, positive: int = POSITIVE_SCORE, negative: int = NEGATIVE_SCORE, needed: int = MIN_PAIRS) -> DataFrame:
    """One row of counts over query logs, in one pass."""
    has = F.col("retrieved_chunks").isNotNull()
    score = F.col("feedback_score")
    counts = logs.agg(
        F.count("*").alias("total_logs"),
        F.count(score).alias("labelled_logs"),
        F.count_if((score >= positive) & has).alias("positive_logs"),
        F.count_if((score <= negative) & has).alias("negative_pairs"),
    )
    pairs = F.col("positive_logs") * 3
    reason = F.format_string(f"%d of the {needed} positive pairs needed, estimated from %d well-rated queries", pairs, F.col("positive_logs"))
    return counts.select("total_logs", "labelled_logs", pairs.alias("positive_pairs"), "negative_pairs", (F.col("total_logs") - F.col("labelled_logs")).alias("unlabelled_logs"), (pairs >= needed).alias("ready_to_train"), F.when(pairs < needed, reason).alias("reason"))


def training_pairs(logs: DataFrame, positive: int = POSITIVE_SCORE) -> DataFrame:
    """(query, chunk, is_positive): one for every non-blank chunk of a well-rated query."""
    good = logs.where(F.col("feedback_score") >= positive).where(T.strip(F.col("query_text")) != "")
    rows = good.select(T.strip(F.col("query_text")).alias("query"), F.explode("retrieved_chunks").alias("c"))
    return rows.select("query", T.strip(F.col("c.content")).alias("chunk")).where("chunk <> ''").withColumn("is_positive", F.lit(True))


def ready_to_train(pairs: DataFrame, needed: int = MIN_PAIRS) -> bool:
    return pairs.limit(needed).count() >= needed


def with_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Query logs with the latest score of each; feedback on unknown logs has no effect."""
    last = feedback.where(F.col("score").between(1, 5)).groupBy("query_id").agg(F.max_by("score", "ts").alias("_score"))
    joined = logs.join(last, logs["id"] == last["query_id"], "left").drop("query_id")
    return joined.withColumn("feedback_score", F.coalesce("_score", "feedback_score")).drop("_score")


def event(spark, job_id: str, status: str, processed: int = 0, total: int = 0, error: str | None = None, result: str | None = None) -> DataFrame:
    """One row to append to the job log: started (running), success, failed, progress."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    row = spark.createDataFrame([(job_id, status, processed, total, error, result)], "job_id string, status string, processed long, total long, error string, result string")
    return row.withColumn("ts", F.current_timestamp()).withColumn("progress", F.when(F.col("status") == "success", 100).otherwise(progress()))


def recent(log: DataFrame, job_type: str, limit: int = 50) -> DataFrame:
    """The newest jobs of a type."""
    return log.where(F.col("job_type") == job_type).orderBy(F.desc_nulls_last("ts"), "job_id").limit(limit)


def query_logs(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Rows for the query log: answers (query_id, query_text, answer, latency_ms) with the document ids of their citations (query_id, index, document_id) in order."""
    cited = citations.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", F.col("document_id").cast("string").alias("d")))).alias("c"))
    found = answers.join(cited, "query_id", "left").select("query_id", "query_text", F.coalesce(F.transform("c", lambda x: x["d"]), F.array().cast("array<string>")).alias("retrieved_doc_ids"), "answer", "latency_ms")
    return found.withColumn("feedback_score", F.lit(None).cast("int")).withColumn("created_at", F.current_timestamp())
