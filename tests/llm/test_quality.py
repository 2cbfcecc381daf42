"""Quality rules: base counts by brute force, held-out accuracy, edge cases."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from textlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é#%\n\t\x0b\x1c\xa0", max_size=60), max_size=6))
def test_counts(texts):
    assert [c for c, _ in quality.examine([t.encode() for t in texts])] == [brute(t) for t in texts]


def good(k):
    return " ".join(f"w{(k * 31 + i * i) % 997} and" for i in range(40))


def bad(k):
    return " ".join(f"W{(k * 17 + i * i) % 997}!!" for i in range(80))


def test_fit_and_verdicts(spark):
    rows = [(i, good(i) if i % 3 else bad(i), "x", i) for i in range(240)]
    extra = [(1000, None, "x", 0), (1001, "", "x", 0), (1002, "few words", "x", 0), (None, good(5), "x", 0), (3, bad(3), "x", 0), (1003, "same words here " * 60, "x", 0), (1004, good(1) + " " + "y" * 200_000, "x", 0)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, kept string, n_words long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.assess(docs, model).collect()
    assert len(out) == len(rows) + len(extra)
    held = [r for r in out if r.doc_id is not None and 160 <= r.doc_id < 240]
    assert sum(r.kept == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in out}
    assert all(by[i].base_failed and not by[i].kept for i in (1000, 1001, 1002, 1003)) and not by[1004].base_failed
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, good(1)), (2, "short")], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.weights is None and [r.kept for r in quality.assess(docs, none).orderBy("doc_id").collect()] == [True, False]
    assert quality.assess(docs.limit(0), none).count() == 0


def test_invalid_utf8_leaves_neighbours_alone(spark):
    import numpy as np

    texts = [b"caf\xe9 \xff\xfe " + good(1).encode(), good(2).encode(), "é naïve 😀".encode(), b"\xc3"]
    alone = [next(iter(quality.examine([quality.valid(t)]))) for t in texts]
    together = list(quality.examine([quality.valid(t) for t in texts]))
    for (a, x), (b, y) in zip(alone, together, strict=True):
        assert a == b and np.array_equal(x, y)
    docs = spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate(texts)], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    assert quality.assess(docs, quality.Model(np.zeros(quality.BINS, np.float32))).count() == 4
