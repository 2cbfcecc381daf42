"""Ranked lexical search: MaxScore over the postings of document shards.

`index` reads the documents once, in Arrow batches. Each block of consecutive documents becomes a row for each of its terms, with the
places of its documents in the block and the term's occurrences, and a row of null term with the documents' ids and lengths. Corpus
statistics (documents, terms, documents with a term) are sums over these rows.

`search` takes items as queries, a group of them at a time, and reads only the postings of their terms. Blocks are dealt out to shards; a
shard goes through its blocks in turn and keeps every item's best documents. An item's terms are sorted by the highest score each can
add in the block. Those whose sum stays below the item's threshold, the score of its last kept document, are non-essential: a document
with none but them can't be kept. Essential lists are added up; the others are probed from the strongest down, and only for documents that may
still reach the threshold with what is left. Shards hand on k rows an item, which are ranked in two steps.

Scores are whole numbers, so results are exact: equal scores go by id, and bounds never cut off a tie. A shard's memory is a block's postings
and k documents an item.

Defined results: null and blank texts, and texts without a letter or digit, have no term and are in no result or count. Rows that repeat an id
are documents of their own and each takes a rank; a null id comes after others of its score. Rows that repeat an item_id are one item with
the terms of all; a null item_id is an item. Items none of whose terms occur get no row. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import keyed_join, limit_batches, materialise, release

#: Documents that an item gets.
K = 10
#: A block ends once it has so many bytes of text or documents; one document may be longer.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
#: Bytes of text that a shard has, about.
SHARD_BYTES = 32 << 20
#: Terms of items, with repeats, that one pass over the postings takes: what tasks hold of the queries.
QUERY_TERMS = 400_000

INDEX = "block long, term string, at array<int>, tf array<int>, ids array<long>, bytes long"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LAST = np.iinfo(np.int64).max


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other characters beyond ASCII; only A-Z lower-cased."""
    return _TERM.findall(text.encode().lower())


class _Block:
    """Postings of consecutive documents, in flat arrays until the block is written."""

    def __init__(self):
        self.ids, self.lengths, self.bytes = [], [], 0
        self.known: dict[bytes, int] = {}
        self.term, self.at, self.tf = [], [], []

    def add(self, doc_id: int | None, text: str) -> None:
        found = terms(text)
        self.bytes += len(text)
        if not found:
            return
        known = self.known
        numbers = np.array([known.setdefault(t, len(known)) for t in found], np.int32)
        distinct, tf = np.unique(numbers, return_counts=True)
        self.term.append(distinct)
        self.tf.append(tf.astype(np.int32))
        self.at.append(np.full(len(distinct), len(self.ids), np.int32))
        self.ids.append(doc_id)
        self.lengths.append(len(found))

    def rows(self, number: int) -> pa.RecordBatch:
        names = sorted(self.known)
        place = np.empty(len(names), np.int32)
        place[[self.known[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        term = place[np.concatenate(self.term)] if self.term else np.empty(0, np.int32)
        order = np.argsort(term, kind="stable")
        flat = lambda parts: np.concatenate(parts)[order] if parts else np.empty(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))]) + len(self.ids)
        offsets = pa.array(np.concatenate([[0], offsets]).astype(np.int32))
        n = len(names) + 1
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([head, flat(rest)]).astype(np.int32))) for head, rest in ((np.arange(len(self.ids)), self.at), (np.array(self.lengths, np.int32), self.tf))]
        ids = pa.array([self.ids, *[None] * len(names)], pa.list_(pa.int64()))
        sizes = pa.array([self.bytes, *[None] * len(names)], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array([None, *(t.decode() for t in names)], pa.string()), *lists, ids, sizes], ["block", "term", "at", "tf", "ids", "bytes"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, block = TaskContext.get().partitionId() << 32, _Block()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block.add(doc_id, text or "")
            if block.bytes >= BLOCK_BYTES or len(block.ids) >= BLOCK_DOCS:
                yield block.rows(number)
                number, block = number + 1, _Block()
    if block.ids:
        yield block.rows(number)


def index(docs: DataFrame) -> DataFrame:
    """Postings of doc_id, text, as a table in the shared folder; see INDEX. The row of null term has a block's ids, lengths and bytes."""
    limit_batches(docs.sparkSession)
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index, INDEX), "postings")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[t.decode() for t in dict.fromkeys(terms(x or ""))] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["item_id", "terms"])


def queries_of(items: DataFrame) -> DataFrame:
    """(item_id, term), once each."""
    limit_batches(items.sparkSession)
    found = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {dict(items.dtypes)['item_id']}, terms array<string>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """An item's best documents so far, highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.null, self.id = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        score, null, ids = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.null, self.id = score[order], null[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


class Postings:
    """A block's lists for the terms asked, with what each posting adds to a score and the most that a list adds."""

    def __init__(self, ids: list, lengths: np.ndarray, lists: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int):
        self.null = np.array([i is None for i in ids], bool)
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        norm = 8 * (100 - 90 + 90 * lengths.astype(np.int64) * n_docs // n_terms)
        self.at, self.adds, self.most = {}, {}, {}
        for term, at, tf in lists:
            tf = tf.astype(np.int64)
            adds = weights[term] * (1_000_000_000 * tf // (1000 * tf + norm[at]))
            self.at[term], self.adds[term], self.most[term] = at, adds, int(adds.max())

    def best(self, asked: np.ndarray, best: Best) -> None:
        """MaxScore of one item over this block."""
        found = sorted((self.most[t], t) for t in asked if t in self.most)
        bound = np.cumsum([most for most, _ in found])
        split = int(np.searchsorted(bound, best.least))  # lists before it can't reach the threshold together
        if split == len(found):
            return
        total = np.zeros(len(self.ids), np.int64)
        for _, t in found[split:]:
            total[self.at[t]] += self.adds[t]
        doc = np.flatnonzero(total)
        score = total[doc]
        for j in range(split - 1, -1, -1):
            open_ = score + bound[j] >= best.least
            doc, score = doc[open_], score[open_]
            if not len(doc):
                return
            at = self.at[found[j][1]]
            place = np.searchsorted(at, doc)
            place[place == len(at)] = 0
            score += np.where(at[place] == doc, self.adds[found[j][1]][place], 0)
        open_ = score >= best.least
        doc, score = doc[open_], score[open_]
        if len(doc):
            best.add(score, self.null[doc], self.ids[doc])


def _searcher(items: list, asked: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]

        def close(ids: list, lengths: np.ndarray, lists: list) -> None:
            block = Postings(ids, lengths, lists, weights, n_docs, n_terms)
            for one, its in zip(asked, best, strict=True):
                block.best(one, its)

        ids, lengths, lists = None, None, []
        for batch in batches:
            number, at, tf, heads = (batch.column(i) for i in range(1, 5))
            number = number.to_pylist()
            for row, term in enumerate(number):
                if term is None:  # the first row of a block
                    if lists:
                        close(ids, lengths, lists)
                    ids, lengths, lists = heads[row].as_py(), tf[row].values.to_numpy(), []
                else:
                    lists.append((term, at[row].values.to_numpy(), tf[row].values.to_numpy()))
        if lists:
            close(ids, lengths, lists)
        rows = [(i, b) for i, b in zip(items, best, strict=True) if len(b.id)]
        if rows:
            item = pa.array([i for i, b in rows for _ in b.id], item_type)
            ids = pa.array(np.concatenate([b.id for _, b in rows]), mask=np.concatenate([b.null for _, b in rows]))
            yield pa.RecordBatch.from_arrays([item, ids, pa.array(np.concatenate([b.score for _, b in rows]))], ["item_id", "doc_id", "score"])

    return run


def _group(postings: DataFrame, queries: DataFrame, totals, k: int, shards: int) -> DataFrame | None:
    """Each shard's k best documents of the queries' items. Queries come to the driver: they are bounded by the caller."""
    spark = postings.sparkSession
    rows = queries.collect()
    if not rows:
        return None
    held = keyed_join(postings.where("term is not null").select("term", F.size("at").alias("df")), queries.select("term").distinct(), "term", "left_semi", len(rows))
    df = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    number = {t: i for i, t in enumerate(df)}
    weights = np.array([weight(totals["docs"], n) for n in df.values()], np.int64)
    of: dict = {}
    for r in rows:
        if r["term"] in number:
            of.setdefault(r["item_id"], []).append(number[r["term"]])
    if not of:
        return None
    numbers = spark.createDataFrame([*number.items()], "term string, number int")
    asked = postings.join(F.broadcast(numbers), "term", "left").where("term is null or number is not null").select("block", "number", "at", "tf", "ids")
    dealt = asked.repartition(shards, "block").sortWithinPartitions("block", F.col("number").asc_nulls_first())
    item_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[dict(queries.dtypes)["item_id"]]
    search_ = _searcher([*of], [np.array(x, np.int32) for x in of.values()], weights, totals["docs"], totals["terms"], k, item_type)
    return dealt.mapInArrow(search_, f"item_id {dict(queries.dtypes)['item_id']}, doc_id long, score long")


def search(postings: DataFrame, items: DataFrame, k: int = K, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of every item's k best documents among an index's; items: item_id, text."""
    spark = postings.sparkSession
    totals = postings.where("term is null").agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms"), F.sum("bytes").alias("bytes")).first()
    queries = materialise(queries_of(items), "queries")
    groups = max(1, -(-queries.count() // query_terms))
    limit_batches(spark)
    found = [spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, doc_id long, score long")]
    if totals["docs"]:
        shards = -(-totals["bytes"] // SHARD_BYTES)
        for g in range(groups):  # a group's terms are known when it starts
            one = _group(postings, queries.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), totals, k, max(1, shards))
            if one is not None:
                found.append(materialise(one, "found"))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    by = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    some = F.row_number().over(Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(*by))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*by))
    out = out.withColumn("of", some).where(F.col("of") <= k).withColumn("rank", rank).where(F.col("rank") <= k)
    out = materialise(out.select("item_id", "rank", "doc_id", "score"), "ranked", max(1, len(found)) * 1_000_000)
    release(*found[1:], queries)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """search over an index of docs that is deleted afterwards."""
    postings = index(docs)
    out = search(postings, items, k)
    release(postings)
    return out
