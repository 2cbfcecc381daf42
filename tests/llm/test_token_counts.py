"""Whole-token shortcut against the libraries."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textlake.llm import pieces, token_counts

from test_tokens import texts


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes string")


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, file):
    path = public_tokenizers.path(file)
    if file.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        want = lambda t: len(processor.encode(t))
    else:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        want = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = [(k, t, "x", "y") for k, t in enumerate(texts())] + [(3, "again", None, None), (3, "again", None, None), (None, "no id", None, None)]
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame(spark, rows), path).collect())
    assert got == sorted((i is None, i, len((t or "").encode()), want(t or ""), want(t or "") > 1024) for i, t, *_ in rows)
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_long_texts_are_walked(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 10)
    library = Tokenizer.from_file(pieces.default_vocabulary())
    token_counts._counters.clear()
    count = token_counts._counter(pieces.default_vocabulary(), token_counts.prove(pieces.default_vocabulary()))
    for t in texts():
        assert count(t or "") == len(library.encode(t or "", add_special_tokens=False).ids)
    token_counts._counters.clear()


def test_proof_holds_whole_tokens_only():
    """Every proven string encodes alone as one token, and strings that do not are left out."""
    path = pieces.default_vocabulary()
    library, proven = Tokenizer.from_file(path), token_counts.prove(path)
    whole = [p for p in proven if p.decode("utf-8", "ignore").encode() == p]
    assert len(whole) > 40_000
    alone = [len(e.ids) for e in library.encode_batch_fast([p.decode() for p in whole], add_special_tokens=False)]
    # the library may split a string into pre-tokens first; no pre-token has such a string
    assert sum(n == 1 for n in alone) > 0.99 * len(whole)


def test_only_the_rest_is_merged():
    asked = []
    count = token_counts.Counter([b" often", "é".encode()], lambda p: asked.append(p) or 2, ["<|x|>"], 10)
    assert count(" often often new é<|x|> often") == 1 + 1 + 2 + 2 + 1 + 1
    assert asked == [" new", " é"]
    for k in range(100):
        assert count(f" w{k}") == 4 and len(count.rest) + len(count.rest.old) <= 10
