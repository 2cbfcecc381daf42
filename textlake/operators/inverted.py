"""An inverted index of documents as a table, and BM25 over it.

Rows are (term, docs): the documents of one block of texts that hold the term, as doc_id, tf and n_words. They lie in BUCKETS folders by a hash of the
term, sorted by term within each file, so a search opens the folders of its terms and skips row groups by term; texts are not read again. Words
are counted a block at a time, where the texts are, and only these rows are shuffled. A frequent term's rows
are spread over SPREAD files by block. Corpus statistics are one row for each batch that was added.

Documents of one id are one document. Null ids and texts without words have no rows; the latter count as no documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import TOP_K
from ..functions import text as T
from ..plans.scratch import materialise, release
from .ranking import K1, B

BUCKETS, SPREAD = 64, 8
#: Bytes of text whose words are counted at a time.
BLOCK = 8_000_000
#: Rows (query, term) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (doc_id, text) of about BLOCK bytes of text, one row at least."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _coded(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of texts, as those of text.words() each, and the text that each is of."""
    split = pc.split_pattern_regex(texts, f"[{T.BLANKS}]+")
    row, word = pc.list_parent_indices(split), pc.list_flatten(split)
    held = pc.not_equal(word, "")
    return row.filter(held).to_numpy().astype(np.int64), word.filter(held).dictionary_encode()


def _counted(ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.ListArray]:
    """Terms of a block and their documents; first a term of null with all documents that have words."""
    row, coded = _coded(texts)
    found, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + row, return_counts=True)
    n_words = np.bincount(row, minlength=len(texts))
    some = np.flatnonzero(n_words)
    at = np.concatenate([some, found % len(texts)])
    starts = np.searchsorted(found, np.arange(len(coded.dictionary) + 1) * len(texts)) + len(some)
    docs = pa.StructArray.from_arrays([ids.take(pa.array(at)), pa.array(np.concatenate([np.zeros(len(some)), tf]), pa.int32(), safe=False), pa.array(n_words[at], pa.int32())], ["doc_id", "tf", "n_words"])
    return pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.cast(pa.string())]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], starts]), pa.int32()), docs)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, docs) of the lower-cased words of each block; a term of null has all its documents that have words. Rows of one id are not yet one document."""
    held = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.lower(F.col(text)).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in _blocks(part):
                yield pa.RecordBatch.from_arrays([*_counted(*block.columns)], ["term", "docs"])

    return held.mapInArrow(run, f"term string, docs array<struct<doc_id: {held.schema['doc_id'].dataType.simpleString()}, tf: int, n_words: int>>")


def _joined(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(term, docs) in which the documents of the given ids, which several rows had, are one each."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    flat = rows.select("term", F.inline("docs"))
    one = flat.join(ids, "doc_id", "left_semi").groupBy("doc_id", "term").agg(F.sum("tf").cast("int").alias("tf"), F.max("n_words").alias("n_words"))
    return flat.join(ids, "doc_id", "left_anti").select("term", "doc_id", "tf", "n_words").unionByName(one).select("term", F.array(F.struct("doc_id", "tf", "n_words")).alias("docs"))


def add(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Add documents of new ids to the index at path."""
    blocks = materialise(postings(docs, key, text), "postings")
    of_doc = materialise(blocks.where("term IS NULL").select(F.inline("docs")).groupBy("doc_id").agg(F.max("n_words").alias("n"), F.count("*").alias("rows")), "documents")
    rows, repeated = blocks.where("term IS NOT NULL"), of_doc.where("rows > 1").select("doc_id")
    if not repeated.isEmpty():
        rows = _joined(rows, repeated)
    dealt = rows.withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.xxhash64(F.col("docs")[0]["doc_id"]), F.lit(SPREAD))).sortWithinPartitions("bucket", "term")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    of_doc.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).coalesce(1).write.mode("append").parquet(f"{path}/stats")  # one row
    release(blocks, of_doc)


def statistics(spark: SparkSession, path: str) -> tuple[int, float]:
    """(documents, mean length)."""
    row = spark.read.parquet(f"{path}/stats").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    return row.docs, row.words / row.docs if row.docs else 0.0


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K, average: float | None = 200.0, idf: float | None = math.log(2)) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of every query (query_id, text), by BM25; a query word counts as often as it is written.

    average None: the corpus's mean length; idf None: ln(1 + (N - df + .5) / (df + .5)). Scores are rounded to nine places, as sums come in any order.
    """
    words = queries.select("query_id", F.explode(T.words(F.lower(F.col("text")))).alias("term"))
    asked = materialise(words.groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("bucket", _bucket()), "asked")
    n = asked.count()
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    held = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets))
    if n <= 10_000:  # few enough to reach the scan's row groups as a list
        held = held.where(F.col("term").isin([r.term for r in asked.select("term").distinct().collect()]))
    docs, mean = statistics(spark, path)
    found = held.join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, ["bucket", "term"]).select("query_id", "term", "times", F.inline("docs"))
    if idf is None:
        df = held.join(F.broadcast(asked.select("bucket", "term").distinct()) if n <= BROADCAST_ROWS else asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
        weight = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        found = found.join(df, "term")
    else:
        weight = F.lit(idf)
    size = K1 * (1 - B + B * F.col("n_words") / (mean if average is None else average))
    part = F.col("times") * weight * (F.col("tf") * (K1 + 1) / (F.col("tf") + size))
    scored = found.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)
