"""Dataset building and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DatasetConfig
from ..functions import text as T
from . import dedup

FORMATS = ("jsonl", "parquet", "huggingface")


def samples(docs: DataFrame, config: DatasetConfig, language: str = "lang") -> DataFrame:
    """doc_id, text, source, language, word_count of documents within the word and language limits."""
    out = docs.where(F.col(language).isin(*config.languages)).select("doc_id", "text", "source", F.col(language).alias("language"), F.inline(F.array(F.struct(T.count_words(F.col("text")).alias("word_count")))))  # counted once
    out = out.where(F.col("word_count").between(config.min_words, config.max_words))
    return out.where(F.col("source").isin(*config.source_types)) if config.source_types else out


def build(docs: DataFrame, config: DatasetConfig = DatasetConfig(), language: str = "lang") -> DataFrame:
    """Filter, then drop near-duplicates by word sets."""
    out = samples(docs, config, language)
    return dedup.deduplicate(out, "drop", "word", 0) if config.deduplicate else out


def counts(docs: DataFrame, built: DataFrame, config: DatasetConfig, language: str = "lang") -> DataFrame:
    """total, filtered, deduplicated and written, in one row."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(docs, "total").crossJoin(one(samples(docs, config, language), "passed")).crossJoin(one(built, "written")).select("total", (F.col("total") - F.col("passed")).alias("filtered"), (F.col("passed") - F.col("written")).alias("deduplicated"), "written")


def write_dataset(built: DataFrame, path: str, fmt: str = "jsonl") -> int:
    """jsonl: five fields; parquet and huggingface: four columns, the latter with a description of itself. Returns the rows written, counted on the way."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; there are {', '.join(FORMATS)}")
    written = Observation()
    built = built.observe(written, F.count(F.lit(1)).alias("n"))
    four = built.select("text", "source", "language", F.col("word_count").cast("int").alias("word_count"))
    if fmt == "jsonl":
        extra = F.col("metadata") if "metadata" in built.columns else F.create_map().cast("map<string,string>")
        four.withColumn("metadata", extra).write.json(path)
    elif fmt == "parquet":
        four.write.parquet(path, compression="snappy")
    else:
        four.write.parquet(f"{path}/data")
        info = json.dumps({"features": {n: {"dtype": t, "_type": "Value"} for n, t in (("text", "string"), ("source", "string"), ("language", "string"), ("word_count", "int32"))}})
        built.sparkSession.createDataFrame([(info,)], "value string").coalesce(1).write.text(f"{path}/dataset_info")
    return written.get["n"]


def read_dataset(spark, path: str, fmt: str = "jsonl") -> DataFrame:
    schema = "text string, source string, language string, word_count int"
    if fmt == "jsonl":
        return spark.read.schema(schema + ", metadata map<string,string>").json(path)
    return spark.read.schema(schema).parquet(path if fmt == "parquet" else f"{path}/data")
