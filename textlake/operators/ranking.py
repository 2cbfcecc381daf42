"""Lexical scores and reciprocal rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LEXICAL_WEIGHT, RERANK_K, RRF_K, VECTOR_WEIGHT
from ..functions import text as T

K1, B = 1.5, 0.75


def _bm25(terms: Column, tokens: Column, average: float, idf: float) -> Column:
    """Sum over terms; counts come from the tokens that are terms at all."""

    def score(x: Column) -> Column:
        size = K1 * (1 - B + B * x["n"] / average)

        def add(total: Column, term: Column) -> Column:
            f = F.size(F.filter(x["hits"], lambda t: t == term)).cast("double")
            return total + F.lit(idf) * (f * (K1 + 1) / (f + size))

        return F.aggregate(x["terms"], F.lit(0.0), add)

    found = lambda x: F.struct(x["terms"].alias("terms"), F.size(x["tokens"]).alias("n"), F.filter(x["tokens"], lambda t: F.array_contains(x["terms"], t)).alias("hits"))
    return T.let(T.let(F.struct(terms.alias("terms"), tokens.alias("tokens")), found), score)


def bm25(query: Column, doc: Column) -> Column:
    """Every query word counts as often as it is written; constant idf ln 2, average length 200."""
    return _bm25(T.words(F.lower(query)), T.words(F.lower(doc)), 200.0, math.log(2))


def bm25_legacy(query: Column, doc: Column, average: float = 100.0) -> Column:
    """Distinct query words, no idf."""
    return _bm25(F.array_distinct(T.words(F.lower(query))), T.words(F.lower(doc)), max(average, 1.0), 1.0)


def rerank(candidates: DataFrame, k: int = RERANK_K, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Fuse the ranks of vector_score and bm25_score of each query's candidates, in `pos` order on ties; ties of the fused score go by vector rank."""
    over = lambda *o: F.row_number().over(Window.partitionBy(*by).orderBy(*o))
    ranked = candidates.withColumn("vector_rank", over(F.desc("vector_score"), "pos")).withColumn("bm25_rank", over(F.desc("bm25_score"), "pos"))
    ranked = ranked.withColumn("score", VECTOR_WEIGHT / (RRF_K + F.col("vector_rank")) + LEXICAL_WEIGHT / (RRF_K + F.col("bm25_rank")))
    return ranked.withColumn("rank", over(F.desc("score"), "vector_rank")).where(F.col("rank") <= k)


def rerank_legacy(candidates: DataFrame, k: int = RERANK_K, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The same fusion; ties of the fused score go by candidate order."""
    over = lambda *o: F.row_number().over(Window.partitionBy(*by).orderBy(*o))
    ranked = candidates.withColumn("vector_rank", over(F.desc("vector_score"), "pos")).withColumn("bm25_rank", over(F.desc("bm25_score"), "pos"))
    ranked = ranked.withColumn("final_score", VECTOR_WEIGHT / (RRF_K + F.col("vector_rank")) + LEXICAL_WEIGHT / (RRF_K + F.col("bm25_rank")))
    return ranked.withColumn("rank", over(F.desc("final_score"), "pos")).where(F.col("rank") <= k)
