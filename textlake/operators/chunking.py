"""One document to many chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..config import CHUNK_OVERLAP, CHUNK_SIZE
from ..functions import text as T

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _pieces(text: str, low: int, high: int, separator: str) -> Iterator[tuple[int, int]]:
    """Ranges between separators."""
    if not separator:
        yield from ((i, i + 1) for i in range(low, high))
        return
    while (at := text.find(separator, low, high)) >= 0:
        yield low, at
        low = at + len(separator)
    yield low, high


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, level: int = 0, low: int = 0, high: int | None = None) -> list[str]:
    """Chunks of up to size characters along the coarsest separators that allow it.

    Adjacent pieces of a level are one range while it is short enough; a piece that is too long alone is split by the next level.
    Each level then puts the end of a chunk before the next one where that fits size + overlap.
    """
    high = len(text) if high is None else high
    separator, out = SEPARATORS[level], []
    a = b = low  # the range held so far, none if empty

    def emit() -> None:
        if b > a:
            out.append(text[a:b])

    for start, end in _pieces(text, low, high, separator):
        if end - (a if b > a else start) <= size:
            a, b = (a if b > a else start), end
            continue
        emit()
        if end - start > size:
            out += split_recursive(text, size, overlap, level + 1, start, end)
            a = b = end
        else:
            a, b = start, end
    emit()
    if not overlap:
        return out
    led = (before[-overlap:] + separator + chunk for before, chunk in zip(out, out[1:], strict=False))
    return out[:1] + [long if len(long) <= size + overlap else chunk for long, chunk in zip(led, out[1:], strict=True)]


@udtf(returnType="chunk_index int, content string, token_count long, metadata map<string,string>", useArrow=True)
class RecursiveChunks:
    """Table function: text, its metadata, size and overlap -> chunks with the metadata and their number; blank chunks leave a gap in the index."""

    def eval(self, text: str, metadata: dict, size: int, overlap: int):
        for k, chunk in enumerate(split_recursive(text or "", size, overlap)):
            if chunk.strip(T.BLANKS):
                yield k, chunk, max(1, len(chunk) // 4), {**(metadata or {}), "chunk_index": str(k)}


def register(spark: SparkSession) -> None:
    """SELECT ... FROM docs, LATERAL recursive_chunks(text, metadata, 512, 64)."""
    spark.udtf.register("recursive_chunks", RecursiveChunks)


def recursive_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, inherit: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_index, content, token_count, metadata): chunks with their document's metadata, and with its columns in `inherit` as entries."""
    spark = docs.sparkSession
    register(spark)
    own = F.col("metadata") if "metadata" in docs.columns else F.create_map().cast("map<string,string>")
    entries = [x for c in inherit for x in (F.lit(c), F.col(c).cast("string"))]
    if entries:
        own = F.map_concat(F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*inherit)), F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()))
    rows = docs.select("doc_id", "text", own.alias("meta"))
    return spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL recursive_chunks(d.text, d.meta, {size}, {overlap}) c", d=rows, size=size, overlap=overlap)


def fixed(c: Column, size: int, overlap: int) -> Column:
    """Array of size-character pieces, one every size - overlap characters."""
    step = size - overlap
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(c, i + 1, F.lit(size)))


def fixed_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    return docs.select("doc_id", F.posexplode(fixed(F.col("text"), size, overlap)).alias("chunk_index", "content"))


def word_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, content, token_count, start_word, end_word): word windows up to the one that reaches the end."""
    overlap = overlap or CHUNK_OVERLAP
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    found = docs.select("doc_id", F.explode(F.array(T.words(F.col("text")))).alias("_w")).where(F.size("_w") > 0)  # exploded, so computed once
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - size) / step).cast("int"))
    rows = found.select("doc_id", "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    end = F.least(start + size, F.size("_w"))
    return rows.select("doc_id", "chunk_index", F.array_join(F.slice("_w", start + 1, F.lit(size)), " ").alias("content"), (end - start).alias("token_count"), start.alias("start_word"), end.alias("end_word"))


def instruction_samples(docs: DataFrame, source: str = "source") -> DataFrame:
    """Summary tasks from the first ten paragraphs of more than 20 words."""
    long = F.filter(F.split(F.col("text"), "\n\n"), lambda p: F.size(T.words(p)) > 20)
    rows = docs.select("doc_id", F.col(source).alias("source"), F.posexplode(F.slice(F.transform(long, T.strip), 1, 10)).alias("sample_index", "p"))
    cut = F.concat(F.substring("p", 1, 200), F.when(F.length("p") > 200, F.lit("...")).otherwise(F.lit("")))
    return rows.select("doc_id", "sample_index", F.lit("Summarize the following passage.").alias("instruction"), F.substring("p", 1, 500).alias("input"), cut.alias("output"), "source")
