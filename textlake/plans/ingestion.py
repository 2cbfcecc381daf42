"""The ingest plan: clean, mark near-duplicates, filter, skip stored texts, chunk, embed, enrich."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as T
from ..functions import urls as U
from ..operators import chunking, cleaning, dedup, vectors
from ..sources import registry
from .scratch import materialise

OUTCOMES = ("rejected", "near_dup", "exact_dup", "indexed")


def enrich(points: DataFrame, dimension: DataFrame, url: str = "url", language: str = "language", given: str | None = None) -> DataFrame:
    """Adds category, source_domain, language ('unknown' if none) and source_type; these win over metadata of the same names."""
    out = registry.resolve_category(points, dimension, url, given)
    out = out.withColumn("language", F.coalesce(F.nullif(T.strip(F.col(language)), F.lit("")), F.lit("unknown")))
    kind = F.col("source_type") if "source_type" in points.columns else F.when(U.is_valid_url(F.col(url)), F.lit("web")).otherwise(F.lit("upload"))
    out = out.withColumn("source_type", kind)
    if "metadata" in points.columns:
        own = F.create_map(*(x for n in ("category", "source_domain", "language", "source_type") for x in (F.lit(n), F.col(n))))
        rest = F.map_filter(F.col("metadata"), lambda k, v: ~k.isin("category", "source_domain", "language", "source_type") & v.isNotNull())
        out = out.withColumn("metadata", F.map_concat(rest, own))
    return out


def outcomes(docs: DataFrame, stored: DataFrame | None = None, languages: tuple[str, ...] = ("en",), near: str | None = None, language: str = "lang", **limits) -> DataFrame:
    """doc_id, text (cleaned), content_hash and outcome of every document.

    stored: (content_hash) of texts that are there already. near: None, or 'drop' to skip near-duplicates, which otherwise are indexed.
    """
    rows = cleaning.clean(docs).withColumn("content_hash", F.sha2("text", 256))
    mark = F.when(F.col(language).isin(*languages), cleaning.verdict(F.col("text"), **limits)["_passes"])
    # cleaned and measured once, as what follows reads the rows several times; of null ids none is kept
    rows = materialise(rows.select("*", F.explode(F.array(mark)).alias("_m")).withColumn("_kept", F.when(F.col("_m") & F.col("doc_id").isNotNull(), True)).drop("_m"), "cleaned")
    if near == "drop":
        marks = dedup.duplicates(rows.where("_kept").select("doc_id", "text")).withColumn("_near", F.lit(True))
        rows = rows.join(marks, "doc_id", "left")
    else:
        rows = rows.withColumn("_near", F.lit(None).cast("boolean"))
    first = rows.where("_kept and _near is null").groupBy("content_hash").agg(F.min("doc_id").alias("_first"))
    if stored is not None:
        first = first.join(stored.select("content_hash"), "content_hash", "left_anti")
    rows = rows.join(first, "content_hash", "left")
    outcome = F.when(F.col("_kept").isNull(), "rejected").when(F.col("_near"), "near_dup").when(F.col("_first") == F.col("doc_id"), "indexed").otherwise("exact_dup")
    return rows.withColumn("outcome", outcome).drop("_kept", "_near", "_first")


def stats(done: DataFrame) -> DataFrame:
    """One row: total and the number of each outcome."""
    return done.agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def points(done: DataFrame, model=vectors.hash_embed, size: int = 512, overlap: int = 64) -> DataFrame:
    """Embedded chunks (id, doc_id, chunk_index, content, token_count, vector) of the indexed documents."""
    chunks = chunking.recursive_chunks(done.where("outcome = 'indexed'"), size, overlap)
    chunks = chunks.withColumn("id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256))
    return vectors.embed(chunks, "content", model)


def embed_documents(documents: DataFrame, ids: DataFrame, model=vectors.hash_embed, size: int = 512, overlap: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, points) after embedding stored documents (doc_id, title, text, ...) of the given ids (doc_id).

    Their status becomes `indexed`, with chunk_count, or `failed` where there is no text; others stay as they are. An id that
    names no document raises KeyError.
    """
    ids = ids.select("doc_id").distinct()
    missing = ids.join(documents.select("doc_id"), "doc_id", "left_anti").first()
    if missing is not None:
        raise KeyError(f"no document {missing.doc_id!r}")
    chosen = documents.join(ids, "doc_id", "left_semi")
    chunks = chunking.recursive_chunks(chosen, size, overlap).withColumn("vector_id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256))
    points = vectors.embed(chunks.join(chosen.select("doc_id", F.col("title").alias("document_title")), "doc_id"), "content", model)
    points = points.select(F.col("vector_id").alias("id"), F.col("doc_id").cast("string").alias("document_id"), "document_title", "chunk_index", "content", "vector")
    counted = ids.join(chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("_n")), "doc_id", "left").select("doc_id", F.coalesce("_n", F.lit(0)).alias("_n"))
    kept = documents.columns
    marked = documents.join(counted, "doc_id", "left")
    for name, value in (("status", F.when(F.col("_n") > 0, "indexed").when(F.col("_n") == 0, "failed")), ("chunk_count", F.col("_n"))):
        marked = marked.withColumn(name, F.coalesce(value, F.col(name)) if name in kept else value)
    return marked.drop("_n"), chunks, points


def embed_job(documents, chunks, points, doc_id, model=vectors.hash_embed, retries: int = 3, note=lambda doc_id, status: None) -> dict:
    """Embed one stored document over three collections (keys doc_id, vector_id, id): processing, then indexed, or failed after so many retries."""
    spark = documents.spark
    for left in range(retries, -1, -1):
        note(doc_id, "processing")
        try:
            ids = spark.createDataFrame([(doc_id,)], ["doc_id"])
            docs, parts, vecs = embed_documents(documents.read(), ids, model)
            parts = materialise(parts, "chunks")
            points.upsert(vecs)
            chunks.upsert(parts)
            documents.replace(docs)
            n = parts.count()
            note(doc_id, "indexed" if n else "failed")
            return {"document_id": doc_id, "chunks": n, "status": "indexed" if n else "failed"}
        except KeyError:
            note(doc_id, "failed")
            raise
        except Exception:
            if not left:
                note(doc_id, "failed")
                raise
            note(doc_id, "retrying")


def process_legacy(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, content_hash, language, chunk_index, content, token_count, start_word, end_word): the older cleaning, then language, hash and word chunks."""
    rows = docs.select("doc_id", T.clean_text_legacy(F.col("text")).alias("text"))
    rows = rows.select("doc_id", "text", T.content_hash(F.col("text")).alias("content_hash"), L.detect_language_or_unknown(F.col("text")).alias("language"))
    return rows.select("doc_id", "content_hash", "language").join(chunking.word_chunks(rows, size, overlap), "doc_id")
