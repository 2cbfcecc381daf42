"""Intent, retrieval, prompts and answers. Models and search services are plug-ins with offline stand-ins."""

from __future__ import annotations

import logging
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIDENCE, RERANK_K, TOP_K, WEB_RESULTS
from ..functions import text as T
from ..plans.scratch import materialise
from ..sources import registry
from . import chunking, cleaning, ranking, vectors

SYSTEM = "You answer from the numbered passages below and cite them by number. If they do not hold the answer, say so."
NOTHING = "None of the stored passages answers this question."


class Llm(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class WebSearch(Protocol):
    def search(self, query: str, limit: int) -> list[dict]: ...


class Extractive:
    """Offline model: the first sentence of the first passage."""

    def complete(self, system: str, user: str) -> str:
        passage = system.partition("[1] ")[2].partition("\n")[2]
        return passage.split("\n\n")[0].partition(". ")[0] or NOTHING


def validate(query: str, k: int, most: int = 50) -> None:
    if not 1 <= len(query) <= 2048:
        raise ValueError("a query has 1 to 2048 characters")
    if not 1 <= k <= most:
        raise ValueError(f"top_k is from 1 to {most}")


def classify(queries: DataFrame, dimension: DataFrame, text: str = "text") -> DataFrame:
    """Adds category and intent_confidence: the topic with most keywords in the query (first on ties), 'general' and 0 without any."""
    topics = dimension.select("ord", "category", "keywords").collect()  # the registry, a fixed list
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array(*(F.struct(sum((F.when(low.contains(w), 1).otherwise(0) for w in t.keywords), F.lit(0)).alias("n"), F.lit(-t.ord).alias("o"), F.lit(t.category).alias("c"), F.lit(len(t.keywords)).alias("m")) for t in topics))
    best = F.array_max(found)
    return queries.withColumn("_b", best).withColumn("category", F.when(F.col("_b.n") > 0, F.col("_b.c")).otherwise(F.lit("general"))).withColumn("intent_confidence", F.when(F.col("_b.n") > 0, F.col("_b.n") / F.col("_b.m")).otherwise(F.lit(0.0))).drop("_b")


def guess_language(category: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in registry.LANGUAGES.items() for x in pair))[category]


def retrieve(query: str, points: DataFrame, k: int = TOP_K, rerank_k: int = RERANK_K, spec: dict | None = None, model=vectors.hash_embed, vector: str = "vector", key: str = "id", content: str = "content", use_intent: bool = True) -> DataFrame:
    """Ranked passages with vector_score, bm25_score, score, rank, and the query's category."""
    validate(query, k)
    spark = points.sparkSession
    asked = classify(spark.createDataFrame([(0, query)], "query_id int, text string"), registry.categories(spark))
    category = asked.first().category
    if use_intent and category != "general":
        own = {n: v for n, v in cleaning.intent_filter([category], None, registry.LANGUAGES.get(category)).items() if n in points.columns}
        spec = cleaning.merge_filters(spec, own)
    hits = vectors.search(points, model([query])[0].tolist(), k, spec, vector=vector, key=key)
    rows = hits.withColumn("query_id", F.lit(0)).withColumnRenamed("score", "vector_score").withColumn("pos", F.col(key)).withColumn("bm25_score", ranking.bm25(F.lit(query), F.col(content)))
    return ranking.rerank(rows.withColumn("intent", F.lit(category)), rerank_k).orderBy("rank")


def retrieve_many(queries: DataFrame, points: DataFrame, k: int = TOP_K, rerank_k: int = RERANK_K, vector: str = "vector", key: str = "id", content: str = "content", use_intent: bool = True) -> DataFrame:
    """retrieve() for a table of queries (query_id long, text, vector): passages with query_id, category, vector_score, bm25_score, score and rank.

    Queries of a topic search the points of its category and language, all queries of a topic at once; those without any hit search
    all points. Topics are the registry's, a fixed list; columns that points lack don't filter. point keys are longs.
    """
    spark = points.sparkSession
    asked = materialise(classify(queries, registry.categories(spark)) if use_intent else queries.withColumn("category", F.lit("general")), "asked")
    space = points.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"), *(c for c in ("category", "language") if c in points.columns))
    as_queries = lambda df: df.select(F.col("query_id").alias("vec_id"), F.col("vector").alias("embedding"))
    topics = [r.category for r in asked.select("category").distinct().collect()]
    hits = None
    for topic in sorted(set(topics) - {"general"}):
        spec = {n: v for n, v in cleaning.intent_filter([topic], None, registry.LANGUAGES.get(topic)).items() if n in points.columns}
        found = vectors.knn(as_queries(asked.where(F.col("category") == topic)), cleaning.where(space, spec), k, itself=True)
        hits = found if hits is None else hits.unionByName(found)
    rest = asked
    if hits is not None:
        hits = materialise(hits, "hits")
        rest = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    wide = vectors.knn(as_queries(rest), space, k, itself=True)
    hits = wide if hits is None else hits.unionByName(wide)
    rows = hits.select("query_id", F.col("vec_id").alias(key), F.col("score").alias("vector_score"), F.col("rank").alias("pos"))
    rows = rows.join(points.drop(*(c for c in ("category", "query_id", "rank", "score", "pos", "text") if c in points.columns and c != content)), key)
    rows = rows.join(asked.select("query_id", F.col("text").alias("asked"), "category"), "query_id")
    return ranking.rerank(rows.withColumn("bm25_score", ranking.bm25(F.col("asked"), F.col(content))), rerank_k)


def answer_many(queries: DataFrame, points: DataFrame, llm: Llm | None = None, confidence: str = "vector_score", doc: str = "document_id", **kw) -> DataFrame:
    """(query_id, category, answer, citations, confidence) of a table of queries; the model runs in tasks and gets a prompt a query. Queries without passages say so."""
    model = llm or Extractive()

    @F.pandas_udf("string")
    def complete(prompts: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([model.complete(f"{SYSTEM}\n\n## Context\n\n{p}", t) for p, t in zip(prompts, texts, strict=True)])

    found = materialise(retrieve_many(queries, points, **kw), "passages")
    listed = found.groupBy("query_id").agg(F.max(confidence).alias("confidence"), F.first("category").alias("category"), F.array_sort(F.collect_list(F.struct(F.col("rank").alias("index"), F.col(doc).alias("document_id"), F.substring("content", 1, 300).alias("excerpt"), "score"))).alias("citations"))
    made = context(found, doc=doc).join(listed, "query_id").join(queries.select("query_id", "text"), "query_id")
    made = made.select("query_id", "category", complete("context", "text").alias("answer"), "citations", "confidence")
    none = queries.select("query_id").join(made.select("query_id"), "query_id", "left_anti")
    return made.unionByName(none.select("query_id", F.lit("general").alias("category"), F.lit(NOTHING).alias("answer"), F.lit(0.0).alias("confidence")), allowMissingColumns=True)


def context(results: DataFrame, by: tuple[str, ...] = ("query_id",), title: str = "document_title", doc: str = "document_id", url: str = "url", content: str = "content") -> DataFrame:
    """One numbered block of passages for each query."""
    name = F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(doc).cast("string"))
    link = F.when(F.coalesce(F.col(url), F.lit("")) != "", F.concat(F.lit(" — "), F.col(url))).otherwise(F.lit(""))
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] **"), name, F.lit("**"), link, F.lit("\n"), F.col(content))
    listed = results.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return listed.select(*by, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("context"))


def citations(results: DataFrame, length: int = 300, title: str = "document_title", doc: str = "document_id", url: str = "url", content: str = "content") -> DataFrame:
    return results.select(*(c for c in ("query_id",) if c in results.columns), F.col("rank").alias("index"), F.col(doc).alias("document_id"), F.col(title).alias("title"), F.col(url).alias("url"), F.substring(content, 1, length).alias("excerpt"), "score")


def web_rows(spark: SparkSession, query: str, service: WebSearch, limit: int = WEB_RESULTS) -> DataFrame:
    """Search results as documents: blank ones dropped, contents cut at 4000 characters, marked as fallback."""
    found = [(r.get("title", ""), r.get("url", ""), r.get("content", "")) for r in service.search(query, limit)[:limit]]
    rows = spark.createDataFrame(found, "document_title string, url string, content string").where(T.strip(F.col("content")) != "")
    return rows.withColumn("content", F.substring("content", 1, 4000)).withColumn("document_id", F.sha2("url", 256)).withColumn("web_fallback", F.lit(True))


def answer(query: str, points: DataFrame, llm: Llm | None = None, web: WebSearch | None = None, threshold: float = CONFIDENCE, confidence: str = "vector_score", **kw) -> dict:
    """Answer with citations; under the threshold (of vector_score, or of score for fused ranks) web results replace the passages if there are any."""
    results = retrieve(query, points, **kw)
    best = results.agg(F.max(confidence)).first()[0] or 0.0
    fallback = False
    if best < threshold and web is not None:
        more = web_rows(points.sparkSession, query, web)
        if not more.isEmpty():
            fallback = True
            results = more.withColumn("rank", F.expr("row_number() over (order by document_id)")).withColumn("score", F.lit(0.0)).withColumn("query_id", F.lit(0))
    rows = context(results).first()
    if rows is None:
        return {"answer": NOTHING, "citations": [], "confidence": best, "used_web_fallback": fallback}
    text = (llm or Extractive()).complete(f"{SYSTEM}\n\n## Context\n\n{rows.context}", query)
    return {"answer": text, "citations": [r.asDict() for r in citations(results).orderBy("index").collect()], "confidence": best, "used_web_fallback": fallback}


def backfill(rows: DataFrame, points, objects=None, model=vectors.hash_embed) -> DataFrame:
    """Clean, chunk, embed and store web_rows(): chunks go to the collection `points`, clean texts to `objects` under web_fallback/.

    A result has the id of its url, so results that come again replace themselves. Returns the points.
    """
    docs = cleaning.clean(rows.select(F.col("document_id").alias("doc_id"), F.col("document_title").alias("title"), "url", F.col("content").alias("text")).dropDuplicates(["doc_id"]))
    chunks = chunking.recursive_chunks(docs).join(docs.select("doc_id", "title", "url"), "doc_id")
    out = chunks.select(
        F.sha2(F.concat_ws(":", "doc_id", F.col("chunk_index").cast("string")), 256).alias("id"),
        F.col("doc_id").alias("document_id"), F.col("title").alias("document_title"), F.col("url").alias("source_url"), "chunk_index", "content", F.lit(True).alias("web_fallback"),
    )
    out = vectors.embed(out, "content", model)
    points.upsert(out)
    if objects is not None:
        for r in docs.collect():  # as many as one search returns
            objects.put_text(f"web_fallback/{r.doc_id}/clean.txt", r.text)
    return out


def search_and_backfill(spark: SparkSession, query: str, service: WebSearch, points=None, objects=None, enabled: bool = True, limit: int = WEB_RESULTS, model=vectors.hash_embed) -> DataFrame:
    """Web results; if enabled they are stored too, and a failure of that is logged and harms no result."""
    rows = web_rows(spark, query, service, limit)
    if enabled and points is not None and not rows.isEmpty():
        try:
            backfill(rows, points, objects, model)
        except Exception:  # noqa: BLE001  the results are there all the same
            logging.getLogger(__name__).exception("results of a web search were not stored")
    return rows
