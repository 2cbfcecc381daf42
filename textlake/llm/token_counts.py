"""Token counts by the whole-token shortcut.

Byte-level BPE merges within pre-tokens only. A vocabulary string that BPE turns into one token costs one wherever it is a pre-token, so
`prove` asks the library's merges once for every string of the vocabulary, offline, and keeps those that come back whole (a string whose
own merges end elsewhere is not one of them). Tasks then count matching pre-tokens directly and merge only the rest.

Files whose ids follow other rules (a normalizer, another splitter) and sentencepiece models go through their library whole, as there
pre-tokens are not strings of the text.

Defined results: a null text is an empty text of no tokens. A special token's string in a text is one token. Every row gets a row, repeated
or null ids included; extra columns are ignored; texts are counted whole, long ones without a list of their pre-tokens. An empty table
gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_letters
from .pieces import _GENERAL, _LATIN, LONGEST, default_vocabulary
from .store import limit_batches
from .token_orc import _plain

#: Tokens that a context holds.
LIMIT = 1024
#: Merged pre-tokens whose counts a worker remembers at most, in two generations.
REMEMBERED = 1_000_000
#: Texts from so many characters on are walked without a list of their pre-tokens.
LONG = 1 << 20

_counters: dict[str, Callable[[str], int]] = {}


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _spec(path: str) -> dict | None:
    """The file's rules if it is byte-level BPE with the usual splitting."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spec if _plain(spec) else None


def prove(path: str) -> frozenset[bytes]:
    """The vocabulary's strings, as UTF-8, that the merges turn into one token when they stand alone."""
    spec, merge, letters = _spec(path), _library(path).model.tokenize, byte_letters()
    if spec is None:
        return frozenset()
    return frozenset(bytes(letters[c] for c in s) for s in spec["model"]["vocab"] if all(c in letters for c in s) and len(merge(s)) == 1)


class Rest(dict):
    """Token counts of the pre-tokens that are not proven, merged when first met; two generations bound them."""

    def __init__(self, merge: Callable[[str], int], remembered: int = REMEMBERED):
        self.merge, self.half, self.old = merge, max(1, remembered // 2), {}

    def __missing__(self, piece: bytes | str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.merge(piece if isinstance(piece, str) else piece.decode("latin-1"))
        if len(piece) <= LONGEST:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[piece] = n
        return n


class Counter:
    """text -> tokens: pre-tokens among `proven` count one each, and `merge` is asked for others."""

    def __init__(self, proven: Iterable[bytes], merge: Callable[[str], int], specials: Iterable[str] = (), remembered: int = REMEMBERED):
        # Latin-1 texts are split as bytes, others as strings; both forms of a proven string are known
        self.proven: set[bytes | str] = set()
        for raw in proven:
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue  # part of a character: no pre-token
            self.proven.add(text)
            try:
                self.proven.add(text.encode("latin-1"))
            except UnicodeEncodeError:
                pass
        self.rest = Rest(merge, remembered)
        self.specials = sorted(specials, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

    def _pieces(self, text: str) -> Iterable[bytes | str]:
        try:
            pattern, text = _LATIN, text.encode("latin-1")
        except UnicodeEncodeError:
            pattern = _GENERAL
        return pattern.findall(text) if len(text) < LONG else (m[0] for m in pattern.finditer(text))

    def _plain(self, text: str) -> int:
        whole, rest, n = self.proven, self.rest, 0
        for piece in self._pieces(text):
            n += 1 if piece in whole else rest[piece]
        return n

    def __call__(self, text: str) -> int:
        if self.cut is None or not any(s in text for s in self.specials):
            return self._plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def _counter(path: str, proven: frozenset[bytes]) -> Callable[[str], int]:
    """One for each worker and vocabulary."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda text: len(processor.encode(text))
        elif _spec(path) is None:
            tokenizer = _library(path)
            _counters[path] = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            tokenizer, letters = _library(path), {b: c for c, b in byte_letters().items()}
            merge = tokenizer.model.tokenize
            _counters[path] = Counter(proven, lambda piece: len(merge(piece.encode().decode("latin-1").translate(letters))), (t.content for t in tokenizer.get_added_tokens_decoder().values()))
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs; vocabulary: a file of one of the libraries, by its path."""
    path, spark = vocabulary or default_vocabulary(), docs.sparkSession
    proven = spark.sparkContext.broadcast(prove(path) if path.endswith(".json") else frozenset())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, proven.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [*map(count, texts)]
            sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    limit_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
