"""Embeddings and vector search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RRF_K, TOP_K
from .cleaning import where

DIM, BATCH = 384, 64


class _Places(dict):
    """word -> its place, or the complement of it where the sign is minus; words met lately are remembered."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= 50_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        out = self[word] = h % self.dim if h >> 63 else ~(h % self.dim)
        return out


_places = cache(_Places)


def hash_embed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Deterministic stand-in for a model: signed hashes of words, L2-normalised."""
    out, places = np.zeros((len(texts), dim), np.float32), _places(dim)
    for row, text in enumerate(texts):
        at = np.fromiter(map(places.__getitem__, (text or "").lower().split()), np.int64)
        out[row] = np.bincount(np.where(at < 0, ~at, at), np.where(at < 0, -1, 1), dim)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str = "text", model: Callable[[list[str]], np.ndarray] = hash_embed, into: str = "vector") -> DataFrame:
    """Adds the model's vectors, in batches; a worker loads the model once."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [v for i in range(0, len(part), BATCH) for v in model(part.iloc[i : i + BATCH].tolist())]
            yield pd.Series(rows, index=part.index)

    return df.withColumn(into, run(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def top_k(points: DataFrame, query: list[float], k: int = TOP_K, spec: dict | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k points of highest cosine among those that meet the filter, ties by key: a filtered scan and a top-k per task."""
    return where(points, spec).withColumn("score", cosine(F.col(vector), literal(query))).orderBy(F.desc("score"), key).limit(k)


def search(points: DataFrame, query: list[float], k: int = TOP_K, spec: dict | None = None, **kw) -> DataFrame:
    """top_k; without the filter if nothing meets it."""
    if spec and where(points, spec).isEmpty():
        spec = None
    return top_k(points, query, k, spec, **kw)


def hybrid(points: DataFrame, query: list[float], k: int = TOP_K, spec: dict | None = None, lexical: DataFrame | None = None, key: str = "vec_id", **kw) -> DataFrame:
    """Twice as many dense hits and, where given, lexical ones (key, rank), fused by reciprocal rank; ties by key.

    lexical: ranked hits for the same query, as of inverted.search(). Those that don't meet the filter are left out before they are
    ranked anew; without them the dense list is alone.
    """
    hits = top_k(points, query, 2 * k, spec, key=key, **kw)
    place = lambda *by: F.row_number().over(Window.orderBy(*by))  # noqa: E731  2k rows
    dense = hits.withColumn("dense_rank", place(F.desc("score"), key))
    if lexical is None:
        return dense.withColumn("rrf", 1 / (RRF_K + F.col("dense_rank"))).orderBy(F.desc("rrf"), key).limit(k)
    met = lexical.select(key, "rank").join(where(points, spec).select(key), key, "left_semi").orderBy("rank").limit(2 * k)
    both = dense.select(key, "dense_rank").join(met.select(key, place("rank").alias("lexical_rank")), key, "full")
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    best = both.withColumn("rrf", part("dense_rank") + part("lexical_rank")).orderBy(F.desc("rrf"), key).limit(k)
    return points.join(F.broadcast(best), key).orderBy(F.desc("rrf"), key)  # k rows


def blocks(rows: DataFrame, key: str, size: int) -> Iterator[list]:
    """A stated query set in blocks of about size rows, by hash of the key; one block is on the driver at a time."""
    n = max(1, -(-rows.count() // size))
    for b in range(n):
        part = (rows if n == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == b)).collect()
        if part:
            yield part


class Best:
    """The k points of highest cosine for each query of a block (ids, a matrix of rows), ties by vec_id; points come in any number of batches.

    Scores are made CELLS at a time, and only those that reach a query's k-th best so far are kept and sorted, so memory doesn't grow with the batch. They
    are rounded, as products of the same vectors differ in their last bits with the shape of the batch.
    """

    CELLS = 500_000

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, itself: bool):
        self.ids, self.matrix, self.k, self.itself = ids, matrix, k, itself
        self.norms, self.worst = np.sqrt((matrix**2).sum(axis=1)), np.full(len(ids), -np.inf)
        self.query, self.name, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, names: np.ndarray, vectors: pd.Series) -> None:
        step = max(1, self.CELLS // max(1, len(self.ids)))
        for i in range(0, len(names), step):
            m = np.stack([np.asarray(v, np.float64) for v in vectors.iloc[i : i + step]])
            self._add(names[i : i + step], m)

    def _add(self, names: np.ndarray, m: np.ndarray) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round((self.matrix @ m.T) / (self.norms[:, None] * np.sqrt((m**2).sum(axis=1))[None]), 12)
        met = np.isfinite(score) & (score >= self.worst[:, None])
        if not self.itself:
            met &= self.ids[:, None] != names[None]
        q, c = np.nonzero(met)
        q, n, s = np.concatenate([self.query, q]), np.concatenate([self.name, names[c]]), np.concatenate([self.score, score[q, c]])
        order = np.lexsort((n, -s, q))
        q, n, s = q[order], n[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep, last = place < self.k, place == self.k - 1
        self.worst[q[last]] = s[last]
        self.query, self.name, self.score = q[keep], n[keep], s[keep]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.query], "vec_id": self.name, "score": self.score})


def knn(queries: DataFrame, points: DataFrame, k: int = TOP_K, block: int = 2000, itself: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest points of every query, other than itself unless `itself`.

    Queries are a stated set: blocks of them go to the tasks, each task keeps its k best for every query, and a second
    step ranks those; points are never paired with each other.
    """
    schema = "query_id long, vec_id long, score double"
    parts = []
    for rows in blocks(queries.select("vec_id", "embedding"), "vec_id", block):
        ids = np.array([r.vec_id for r in rows], np.int64)
        matrix = np.array([r.embedding for r in rows], np.float64)

        def run(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            best = Best(ids, matrix, k, itself)
            for batch in batches:
                best.add(batch.vec_id.to_numpy(), batch.embedding)
            yield best.frame()

        parts.append(points.select("vec_id", "embedding").mapInPandas(run, schema))
    if not parts:
        return points.sparkSession.createDataFrame([], schema + ", rank int")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_results(hits: DataFrame, key: str = "id", doc: str = "document_id", title: str = "document_title", content: str = "content") -> DataFrame:
    """Hits as (id, score, document_id, document_title, content, metadata): missing texts are empty, all other scalar fields are metadata."""
    text = lambda n: (F.coalesce(F.col(n).cast("string"), F.lit("")) if n in hits.columns else F.lit("")).alias
    kinds = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "timestamp", "date")
    rest = [n for n, kind in hits.dtypes if n not in (key, "score", doc, title, content) and kind in kinds]
    pairs = F.create_map(*(x for n in rest for x in (F.lit(n), F.col(n).cast("string")))) if rest else F.create_map().cast("map<string,string>")
    return hits.select(F.col(key).cast("string").alias("id"), "score", text(doc)("document_id"), text(title)("document_title"), text(content)("content"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("metadata"))
