"""BPE by dynamic programming and ORC files of token ids against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from textlake.llm import bpe, pieces, token_orc

ODD = ["", None, "a" * 3000, "  \n\n  x ", "it's we're''s 'll", "x<|endoftext|>y <|endoftext|>", "日本語😀 naïve café b\x85 \x1c\x1d z", "²³½ 12ab３４", "'S 'T", " \t \n", "Œuvre", "\x00\x01", "word " * 30_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(pieces.default_vocabulary())


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab cdtheingon  '\n.1!é日") for _ in range(rng.randint(1, 80))) for _ in range(400)] + ["".join(rng.choice("ab") for _ in range(40)) for _ in range(100)]


def test_encode(library):
    model = bpe.model(pieces.default_vocabulary())
    fast = token_orc.library_encoder(pieces.default_vocabulary())
    for t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        for packed in (model.encode(t or ""), *fast([t or ""])):
            assert np.frombuffer(packed, "<u4").tolist() == ids
        assert model.decode(model.encode(t or "")) == library.decode(ids, skip_special_tokens=False)


def test_memory_of_pieces_is_bounded():
    asked = []
    encoder = pieces.PieceEncoder(lambda p: asked.append(p) or p.encode(), {}, 10)
    for k in range(1000):
        assert encoder.ids(f" often w{k}") == f" often w{k}".encode()
        assert len(encoder.memo) + len(encoder.memo.old) <= 10
    assert asked.count(" often") == 1
    assert encoder.ids("y" * 1000) == b"y" * 1000 and "y" * 1000 not in encoder.memo


def test_other_files_go_through_the_library_whole(tmp_path, library):
    spec = json.loads(library.to_str())
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(spec))
    lower = Tokenizer.from_file(str(tmp_path / "lower.json"))
    for t in texts():
        assert np.frombuffer(token_orc.library_encoder(str(tmp_path / "lower.json"))([t or ""])[0], "<u4").tolist() == lower.encode(t or "", add_special_tokens=False).ids


def frame(spark):
    rows = [(i * 2, t, "x") for i, t in enumerate(texts())]
    return rows, spark.createDataFrame([*rows, (4, "again", "x"), (None, "none", "x")], "doc_id long, text string, ids string")


def test_digests(spark, library):
    rows, df = frame(spark)
    out = {}
    for r in bpe.digests(df.repartition(3)).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(rows) + 2
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert want in {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out[i]}
    plain = df.where("doc_id = 6")
    assert bpe.decode(bpe.encode(plain)).first().text == plain.first().text
    assert bpe.digests(df.limit(0)).count() == 0


def test_orc(spark, library, tmp_path):
    rows, df = frame(spark)
    df = df.where("doc_id <> 4 or text <> 'again'")
    out = {r.doc_id: r for r in token_orc.round_trip(df.repartition(5)).collect()}
    start = out[None].n_tokens
    assert out[None].start == 0
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        r = out[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_orc.write(df, f"file://{tmp_path}/o")
    assert token_orc.lookup(spark, f"file://{tmp_path}/o", [8]).count() == 1
    assert token_orc.round_trip(df.limit(0)).count() == 0
