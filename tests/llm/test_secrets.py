"""Secret scans against a Python scanner."""

import hashlib
import math
import random
import re
import time
from collections import Counter

from textlake.llm import secret_scan as S

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PARTS = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", '"', "'", " ", ":", "=", "é", "\n", "AKIA", "ABCDEFGH12", "0123456789abcdef", "deadbeef", "xyz", "kJ8sP2xQ9vL4mN7bR3tY6wZ1", "plain words", "-", "."]


def test_base_spans(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(600)] + [None, "", "token:secret: abcdefghijklmnop", "token==abcdefghijk", "x" * 200_000 + " token=abcdefghijkl", "0123456789abcdef " * 2000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, "token=abcdefghijkl", "z")], "doc_id long, text string, spans string")
    rows = S.scan(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = base(texts[r.doc_id]) if r.doc_id is not None else [("assign", 0, 18)]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in S.KINDS[:3]]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert joined(s for s in (tuple(x.split(":")) for x in r.spans.split(",") if x) if s[0] != "entropy") == joined(want)
    assert S.scan(df.limit(0)).count() == 0


def test_entropy_and_redaction(spark):
    key = "kJ8sP2xQ9vL4mN7bR3tY6wZ1"
    uuid = "6f1e7c2a-9b3d-4e5f-8a7b-0c1d2e3f4a5B"
    rows = [(1, f"key {key} end", 5), (2, f"{uuid} " + "ththanorthatanthlythand" + " AAAAAAAAAA0AAAAAAAAAAAAAAAAA EXAMPLE" + key, 5), (3, None, None), (4, 'a token = "abcdefghijklmnop0123456789abcdef" b', 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in S.scan(df).collect()}
    assert spans[1] == "entropy:4:28" and spans[2] == "" and spans[3] == ""
    out = {r.doc_id: r for r in S.redact(df).collect()}
    assert out[1].text == "key [SECRET] end" and out[1].n_chars == len(out[1].text)
    assert out[2].text == rows[1][1] and out[2].n_chars == 5 and out[3].text is None
    assert out[4].text == 'a [SECRET]" b' and S.redact(df).columns == df.columns


def hot(text, found):
    """Entropy spans, window by window, that overlap no base span."""
    out = []
    for m in re.finditer(S.CANDIDATE, text):
        c = m[0]
        if re.search(S.ALLOW, c):
            continue
        limit = S.LIMITS["hex" if re.fullmatch("[0-9a-fA-F]+", c) else "mixed"]
        at = []
        for i in range(len(c) - S.WINDOW + 1):
            n = Counter(c[i : i + S.WINDOW]).values()
            if -sum(k / S.WINDOW * math.log2(k / S.WINDOW) for k in n) >= limit - 1e-9:
                at.append(i)
        if at:
            span = m.start() + at[0], m.start() + at[-1] + S.WINDOW
            if not any(a < span[1] and span[0] < b for _, a, b in found):
                out.append(("entropy", *span))
    return out


def replaced(text, spans):
    out, at = "", 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], S.KINDS.index(s[0]))):
        if a >= at:
            out += text[at:a] + S.REDACTED
        at = max(at, b)
    return out + text[at:]


def test_entropy_spans_and_redaction_against_brute_force(spark):
    rng = random.Random(8)
    kinds = ["0123456789abcdef", S.SIGNS, "ab01", "ABCDEFGH1", "aaaaaaaaab1"]
    part = lambda: "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(5, 60))) if rng.random() < 0.6 else rng.choice(PARTS)
    texts = [rng.choice(["", "\ufeff", "😀é "]) + "".join(part() + rng.choice([" ", "", "\n", "\ufeff"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned, cut, seen = {r.doc_id: r.spans for r in S.scan(df).collect()}, {r.doc_id: r.text for r in S.redact(df).collect()}, 0
    for i, t in enumerate(texts):
        found = base(t)
        extra = hot(t, found)
        seen += len(extra)
        assert scanned[i] == joined(sorted(found + extra, key=lambda s: (s[1], S.KINDS.index(s[0]))))
        assert cut[i] == replaced(t, found + extra)
    assert seen > 100


def test_many_matches_in_a_text(spark):
    rng = random.Random(9)
    text = " ".join("%016x%s" % (rng.getrandbits(64), "" if k % 4 else " kJ8sP2xQ9vL4mN7bR3tY6wZ1") for k in range(200_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = S.scan(df).first()
    assert row.n_hex == 200_000 and row.base_sha256 == hashlib.sha256(joined(base(text)).encode()).hexdigest() and row.spans.count("entropy") == 50_000
    assert S.redact(df).first().text == replaced(text, base(text) + [("entropy", m.start(), m.end()) for m in re.finditer("kJ8sP2xQ9vL4mN7bR3tY6wZ1", text)])
    blob = "".join(rng.choice(S.SIGNS) for _ in range(500_000))
    assert S.scan(spark.createDataFrame([(1, f"{blob} x")], "doc_id long, text string")).first().spans.startswith("entropy:")
    assert time.time() - began < 120


def test_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Python" not in S.scan(df)._jdf.queryExecution().toString()
