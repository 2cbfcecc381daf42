"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece, exactly one token can end its encoding. An automaton over the vocabulary with suffix links lists the
tokens that end at a position; the one is right that either covers the prefix or is compatible with the last token of the
prefix before it, which is to say that BPE of the two tokens' bytes gives the two again. Back-pointers from the
end emit the ids. Time is linear in the piece for a given vocabulary, whatever repeats in it.

Defined results: a null text is an empty text with no ids. A special token's string in a text is its id. Every row gets a
row, repeated or null ids included; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceEncoder, default_vocabulary
from .store import limit_batches

#: Compatibility tests that a worker remembers at most.
PAIRS = 1_000_000
#: Pieces that a worker remembers at most: about 60 MB; in the pipeline, memory is shared with other stages.
PIECES = 400_000

_models: dict[str, PrefixBpe] = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes[i] = s
        for s, i in special.items():
            self.bytes[i] = s.encode()
        # a merge's rank is its line; it makes a token of two others
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            one, two, both = vocab[left], vocab[right], vocab[left + right]
            self.made[one, two] = (rank, both)
            self.parts.setdefault(both, (rank, one, two))
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if len(s) == 1 or i in self.parts:
                self.automaton.add_word(s.decode("latin-1"), (i, len(s)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.encoder = PieceEncoder(lambda piece: np.array(self.encode_piece(piece.encode()), "<u4").tobytes(), special, PIECES)

    def compatible(self, left: int, right: int) -> bool:
        """BPE of left's and right's bytes is left, right: no merge across their border comes before the merges that close it off.

        The border's tokens are taken apart step by step, the later merge first; a merge across it of a lower rank than the
        one just undone would have come first and so have broken the token.
        """
        made, parts = self.made, self.parts
        undone, from_left = len(made), False
        while True:
            across = made.get((left, right))
            # at equal place the left one of two merges comes first; ranks differ otherwise
            if across and (across[0] < undone or across[0] == undone and not from_left):
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                undone, left, from_left = a[0], a[2], True
            else:
                undone, right, from_left = b[0], b[1], False

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            at = end - length
            if at:
                before = last[at]
                if before < 0:
                    continue
                key = before << 20 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > PAIRS:
                        fits.clear()
                    ok = fits[key] = self.compatible(before, token)
                if not ok:
                    continue
            last[end], start[end] = token, at
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        return self.encoder.ids(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def model(path: str) -> PrefixBpe:
    """One for each worker and vocabulary."""
    if path not in _models:
        _models[path] = PrefixBpe(path)
    return _models[path]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(bpe.encode, _texts(batch.column(1))), pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (packed little-endian unsigned 32-bit integers) of every row of docs."""
    limit_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encoder(vocabulary or default_vocabulary()), f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(bpe.decode, batch.column(1).to_pylist()), pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids)."""
    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(_decoder(vocabulary or default_vocabulary()), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def _digester(path: str, with_ids: bool):
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            ids = [*map(bpe.encode, _texts(batch.column(1)))]
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array(map(sha, ids), pa.string()),
                "decoded_sha256": pa.array([sha(bpe.decode(x).encode()) for x in ids], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def digests(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, in one pass over docs; with_ids: the packed ids too."""
    limit_batches(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_digester(vocabulary or default_vocabulary(), with_ids), schema)
