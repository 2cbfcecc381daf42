"""From raw documents to token ids: quality rules, near-duplicates, decontamination, secrets, encoding.

Defined results: null and blank texts fail the quality rules, and later stages alone keep them as they are (no group, no leak, no secret, no
token). Rows that repeat an id are one document and one of them stays, rows of null id one for each distinct text, see near_dup.keep_one.
Very long texts are processed whole. Columns besides doc_id and text pass through all stages but the last, whatever their names. Empty
tables of documents, labels or a benchmark give stages that drop nothing for want of them, and an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlake.llm import bpe, decontam, near_dup, quality, secret_scan
from textlake.llm.store import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, which is fitted on these documents' labels."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dup.keep_one(docs, percent=80, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, with_ids=True)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", redact_secrets), ("encode", encode)]

#: A trained classifier and an LSH forest are not SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
