"""Exact and near duplicates.

The greedy pass keeps a document unless an earlier kept one collides with it in some band. It is the lexicographically
first independent set of documents over bands: in each round, an undecided document that comes first in all its
bands is kept, and the others of those bands are duplicates. Rows are (document, band) only; no pairs are
made, and equal signatures count as one document, so crowded bands cost what their rows cost. Bands that one document has alone
decide nothing and go first; once FINISH rows or fewer are left, a single task decides them in order, so rounds, which a
long chain of collisions needs, come to an end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JACCARD, NUM_PERM
from ..plans.scratch import materialise, release

BANDS, ROWS = 8, 16
MIN_CHARS = 50
#: Narrow (document, band) rows that one task decides in order: about 16 MB.
FINISH = 1_000_000
#: Multiplier of the hash of character shingles.
STEP = 0x01000193


def permutations() -> list[tuple[int, int]]:
    """NUM_PERM pairs (odd factor, offset) of 32 bits by a fixed congruential sequence."""
    x, out = 1, []
    for _ in range(NUM_PERM):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            pair.append(x >> 32)
        out.append((pair[0] | 1, pair[1]))
    return out


_A, _B = (np.array(x, np.uint32) for x in zip(*permutations(), strict=True))


def exact(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """(content_hash, kept, copies) of every distinct text: the first document of each, by partial aggregation."""
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min(order).alias("kept"), F.count("*").alias("copies"))


def new_only(batch: DataFrame, stored: DataFrame, order: str = "doc_id") -> DataFrame:
    """Rows of a batch whose text is neither stored nor earlier in the batch."""
    hashed = batch.withColumn("content_hash", F.sha2("text", 256))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias(order))
    return hashed.join(first, ["content_hash", order], "left_semi").join(stored.select("content_hash"), "content_hash", "left_anti")


def _grams(text: str, k: int = 5) -> np.ndarray:
    """32-bit hashes of all k-grams of lower-cased characters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    if len(points) < k:
        return np.empty(0, np.uint32)
    h = np.zeros(len(points) - k + 1, np.uint32)
    for i in range(k):
        h = h * np.uint32(STEP) + points[i : i + len(h)]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def char_shingles(text: str, k: int = 5) -> np.ndarray:
    """The distinct ones of them; none for shorter texts."""
    return np.unique(_grams(text, k))


class _WordHashes(dict):
    """word -> the first digits of its MD5; words met lately are remembered, unless they are long."""

    MOST, LONGEST = 100_000, 64

    def __missing__(self, word: str) -> int:
        out = int.from_bytes(hashlib.md5(word.encode("utf-8", "replace")).digest()[:4], "big")
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = out
        return out


_word_hashes = _WordHashes()


def word_shingles(text: str) -> np.ndarray:
    """32-bit hashes of the distinct lower-cased words."""
    return np.unique(np.fromiter(map(_word_hashes.__getitem__, set((text or "").lower().split())), np.uint32))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """NUM_PERM minima of (a * h + b) mod 2**32; the largest number for an empty set."""
    out = np.full(NUM_PERM, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 512):
        np.minimum(out, (shingles[None, i : i + 512] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def _each(texts: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow batch, one of which is a Python object at a time."""
    return (t.as_py() for t in texts)


def _shingler(kind: str):
    return _grams if kind == "char" else word_shingles  # repeats change no minimum


def signatures(docs: DataFrame, kind: str = "char") -> DataFrame:
    """doc_id and signature of every row."""
    shingle = _shingler(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.concatenate([np.empty(0, np.int64), *(minhash(shingle(t)).astype(np.int64) for t in _each(part.column(1)))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, NUM_PERM, dtype=np.int32)), pa.array(values))
            out = pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "signature"])
            del part  # before the next one comes
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, signature array<long>")


def banded(docs: DataFrame, kind: str = "char") -> DataFrame:
    """doc_id, same (equal for equal signatures) and bands (BANDS keys of ROWS values each) of every row."""
    shingle = _shingler(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            same, keys = [], []
            for text in _each(part.column(1)):
                signature = minhash(shingle(text))
                same.append(hashlib.blake2b(signature.tobytes(), digest_size=16).digest())
                for band in range(BANDS):
                    of = signature[band * ROWS : (band + 1) * ROWS].tobytes()
                    keys.append(int.from_bytes(hashlib.blake2b(of, digest_size=8, salt=bytes([band])).digest(), "little", signed=True))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys, pa.int64()))
            out = pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), lists], ["doc_id", "same", "bands"])
            del part  # before the next one comes
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, same binary, bands array<long>")


def _in_order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (doc_id, bands), by doc_id -> (doc_id, is_duplicate)."""
    taken: set[int] = set()
    for part in parts:
        marks = []
        for bands in part.column(1).to_pylist():
            marks.append(not taken.isdisjoint(bands))
            if not marks[-1]:
                taken.update(bands)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.bool_())], ["doc_id", "is_duplicate"])


def _crowded(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, band) of bands that two documents or more have."""
    shared = rows.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("band")
    return rows.join(shared, "band")


def duplicates(docs: DataFrame, kind: str = "char", min_chars: int = MIN_CHARS, finish: int = FINISH) -> DataFrame:
    """doc_id of every document that collides with an earlier kept one; texts under min_chars are never duplicates nor compared."""
    return collisions(materialise(banded(docs.where(F.length("text") >= min_chars), kind), "signed"), finish)


def collisions(signed: DataFrame, finish: int = FINISH) -> DataFrame:
    """The same over rows of banded(), which are read several times."""
    heads = signed.groupBy("same").agg(F.min("doc_id").alias("head"))
    own = signed.join(heads, (signed["same"] == heads["same"]) & (signed["doc_id"] == heads["head"]), "left_semi")
    rows = materialise(_crowded(own.select("doc_id", F.explode("bands").alias("band")).distinct()).select("doc_id", "band"), "bands")
    decided = []
    while (left := rows.count()) > finish:
        first = rows.groupBy("band").agg(F.min("doc_id").alias("first"))
        placed = rows.join(first, "band")
        kept = materialise(placed.groupBy("doc_id").agg(F.bool_and(F.col("first") == F.col("doc_id")).alias("all")).where("all").select("doc_id", F.lit(False).alias("is_duplicate")), "kept")
        hit = rows.join(kept, "doc_id", "left_semi").select("band").distinct()
        gone = materialise(rows.join(hit, "band", "left_semi").select("doc_id").distinct().join(kept, "doc_id", "left_anti").withColumn("is_duplicate", F.lit(True)), "gone")
        decided += [kept, gone]
        was, rows = rows, materialise(_crowded(rows.join(kept.unionByName(gone), "doc_id", "left_anti")).select("doc_id", "band"), "bands")
        release(was)
    if left:
        rest = rows.groupBy("doc_id").agg(F.collect_list("band").alias("bands")).coalesce(1).sortWithinPartitions("doc_id")  # `finish` rows at most
        decided.append(rest.mapInArrow(_in_order, "doc_id long, is_duplicate boolean"))
    later = signed.join(heads, "same").select("doc_id", "head")
    out = later.where("doc_id <> head").select("doc_id")
    if decided:
        gone = reduce(DataFrame.unionByName, decided).where("is_duplicate").select(F.col("doc_id").alias("head"))
        out = out.unionByName(later.join(gone, "head", "left_semi").select("doc_id"))
    return out.distinct()


def greedy_marks(docs: DataFrame, kind: str = "char", min_chars: int = MIN_CHARS, finish: int = FINISH) -> DataFrame:
    """doc_id and is_duplicate of every row, in order of doc_id."""
    marks = duplicates(docs, kind, min_chars, finish).withColumn("is_duplicate", F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(marks, "doc_id", "left").select("doc_id", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"))


def deduplicate(docs: DataFrame, mode: str = "mark", kind: str = "char", min_chars: int = MIN_CHARS) -> DataFrame:
    """mark: docs with is_duplicate; drop: docs without duplicates."""
    if mode == "drop":
        return docs.join(duplicates(docs, kind, min_chars), "doc_id", "left_anti")
    return docs.join(greedy_marks(docs, kind, min_chars), "doc_id")


def _in_parts(signed: DataFrame, n: int) -> DataFrame:
    """doc_id, same (equal for equal signatures), signature as bytes and parts (keys of its n parts) of every row (doc_id, signature)."""
    edges = [NUM_PERM * k // n for k in range(n + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, raw, keys = [], [], []
            for values in np.asarray(batch.column(1).flatten(), np.int64).astype(np.uint32).reshape(-1, NUM_PERM):
                raw.append(values.tobytes())
                same.append(hashlib.blake2b(raw[-1], digest_size=16).digest())
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    keys.append(int.from_bytes(hashlib.blake2b(values[a:b].tobytes(), digest_size=8, salt=bytes([k])).digest(), "little", signed=True))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, n, dtype=np.int32)), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(raw, pa.binary()), lists], ["doc_id", "same", "signature", "parts"])

    return signed.select(F.col("doc_id").cast("long").alias("doc_id"), "signature").mapInArrow(run, "doc_id long, same binary, signature binary, parts array<long>")


def _alike(pairs: DataFrame, asked: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """doc_id of the pairs (doc_id, of, same) whose signatures, `of` among asked and `same` among held, agree in `least` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, NUM_PERM) for k in (1, 2))
            yield batch.select([0]).filter(pa.array((a == b).sum(axis=1) >= least))

    of = asked.select(F.col("same").alias("of"), F.col("signature").alias("a")).dropDuplicates(["of"])
    met = held.join(_small(pairs.select("same").distinct()), "same", "left_semi").select("same", F.col("signature").alias("b")).dropDuplicates(["same"])
    return pairs.join(of, "of").join(met, "same").select("doc_id", "a", "b").mapInArrow(run, "doc_id long").distinct()


def _small(rows: DataFrame) -> DataFrame:
    """Rows that are broadcast where they are few; the other side stays where it is."""
    return F.broadcast(rows) if rows.count() <= FINISH else rows


def like_any(queries: DataFrame, stored: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """(query_id, is_duplicate): whether a signature stored under another id agrees in threshold of its values; queries are a stated set.

    Signatures that agree in so many values agree in all values of one part at least, if there is a part more than values that may differ.
    So stored signatures that share a part with a query, and no others, are compared, once for equal ones. Each query meets
    two of every part first, which settles those in large groups of near copies; only the others meet all that share a part.
    """
    least = next(k for k in range(NUM_PERM + 2) if k / NUM_PERM >= threshold)
    if not 0 < least <= NUM_PERM:
        raise ValueError("threshold must be above 0 and at most 1")
    n = NUM_PERM - least + 1
    asked, held = materialise(_in_parts(queries, n), "asked"), materialise(_in_parts(stored, n), "held")
    span = F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    other = (F.col("low") != F.col("doc_id")) | (F.col("high") != F.col("doc_id"))
    equal = held.select("same", "doc_id").join(_small(asked.select("same").distinct()), "same", "left_semi").groupBy("same").agg(*span)
    hits = materialise(asked.select("same", "doc_id").join(equal, "same").where(other).select("doc_id").distinct(), "hits")
    keys = asked.select("doc_id", F.col("same").alias("of"), F.explode("parts").alias("part")).distinct()
    left = materialise(keys.join(hits, "doc_id", "left_anti"), "left")
    shared = held.select("doc_id", "same", F.explode("parts").alias("part")).join(_small(left.select("part").distinct()), "part", "left_semi")
    near = materialise(shared.groupBy("part", "same").agg(*span), "near")
    whole = F.struct("same", "low", "high")
    ends = near.groupBy("part").agg(F.array(F.min(whole), F.max(whole)).alias("ends")).select("part", F.inline("ends"))
    for some in (ends, near):
        pairs = materialise(left.join(some, "part").where((F.col("of") != F.col("same")) & other).select("doc_id", "of", "same").distinct(), "pairs")
        more = materialise(_alike(pairs, asked, held, least), "hits")
        hits, left = hits.unionByName(more), left.join(more, "doc_id", "left_anti")
        release(pairs)
    release(asked, held, near)
    marks = hits.select(F.col("doc_id").alias("query_id")).distinct().withColumn("hit", F.lit(True))
    return queries.select(F.col("doc_id").alias("query_id")).join(marks, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("is_duplicate"))
