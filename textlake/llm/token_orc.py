"""Token ids in ORC: stripes of run-length encoded integers with row indexes, and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id and sorted, so files follow each other in doc_id order; each row has its task's number
and its place in it. Readers work on stripes in parallel, and point lookups skip files, stripes and row groups by their
statistics and Bloom filters. Where a document starts in the whole sequence follows from the sums of the
parts before its own and of the rows before it in its part.

Ids are those of the tokenizers library, whose merges are asked for pieces that a worker has not met lately. Every document ends
with END. Defined results: a null text has END alone; rows that repeat a doc_id follow each other; null ids come
first. Extra columns are ignored. An empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_letters
from .pieces import PieceEncoder, default_vocabulary
from .store import drop_at_exit, limit_batches, materialise, scratch_path

END = 0
SCHEMA = "doc_id long, part int, pos long, ids array<int>"
ROW_STRIDE, STRIPE_BYTES = 1000, 32 << 20
#: Rows that the ORC reader decodes at a time.
READ_ROWS = 256

_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> packed ids, as the library encodes whole texts; one for each worker and vocabulary.

    Where the file asks for nothing but byte-level splitting, pieces are split here and the library's merges asked for new ones only;
    files with a normalizer, another splitter, or other special rules go through the library whole.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _encoders[path] = _by_piece(tokenizer).ids_of if _plain(spec) else _whole(tokenizer)
    return _encoders[path]


def _plain(spec: dict) -> bool:
    """The file is byte-level BPE with the usual splitting, and nothing else changes its ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
    splits = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    marks = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens", ()))
    return model.get("type") == "BPE" and not odd and spec.get("normalizer") is None and splits and marks


def _whole(tokenizer):
    def ids_of(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return ids_of


def _by_piece(tokenizer) -> PieceEncoder:
    merge, letters = tokenizer.model.tokenize, {b: c for c, b in byte_letters().items()}
    packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
    blank = letters[32]

    def new(piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalnum() and piece[0] == " ":  # most pieces
            word = blank + piece[1:]
        else:
            word = piece.encode().decode("latin-1").translate(letters)
        return b"".join([packed[t.id] for t in merge(word)])

    return PieceEncoder(new, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()})


def _encoder(path: str):
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, pos = library_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + end for x in encode([x or "" for x in batch.column(1).to_pylist()])]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(pos, pos + len(ids), dtype=np.int64)), lists], ["doc_id", "part", "pos", "ids"])
            pos += len(ids)

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    limit_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    out = rows.mapInArrow(_encoder(vocabulary or default_vocabulary()), SCHEMA)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(ROW_STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "compression": "lz4"}
    out.write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; a batch of the reader is READ_ROWS documents, whose ids it unpacks."""
    spark.conf.set("spark.sql.orc.columnarReaderBatchSize", str(READ_ROWS))
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a few documents; the predicate reaches the row indexes and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(ids))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _encoders.clear()  # the worker may have encoded before
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        held = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])


def measured(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    limit_batches(spark)
    rows = materialise(read(spark, path).mapInArrow(_measure, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long"), "measured")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write to the shared folder and read back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary)
    drop_at_exit(docs.sparkSession, path)
    return measured(docs.sparkSession, path)
