"""MaxScore against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from textlake.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "é", "naïve", "日本", "x9"]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice([5, 50, 305])]) for _ in range(rng.randint(1, 60)))
    return [(k, text()) for k in range(n)]


def check(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, score string, term string").repartition(3)
    q = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, rank string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(lexical.index(d), q, **how).collect()), key=str)
    assert got == brute(docs, items, how.get("k", 10))


def test_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 40)
    monkeypatch.setattr(lexical, "SHARD_BYTES", 10_000)
    rng = random.Random(3)
    docs = corpus(rng, 500)
    docs += [(500 + k, docs[7][1]) for k in range(60)] + [(7, docs[7][1]), (None, docs[7][1]), (None, docs[8][1])]  # ties of many copies, repeated and null ids
    docs += [(900, None), (901, ""), (902, " .-! "), (903, "W1 W2," * 30_000), (904, "É é naïve-日本"), (905, "w1\x00w2\x7fw3_w4")]
    items = [(k, docs[rng.randrange(500)][1]) for k in range(25)] + [(100, docs[7][1]), (101, None), (102, "..."), (103, "no such"), (1, "w250 w251"), (None, "É 日本"), (104, docs[-1][1])]
    check(spark, docs, items)
    check(spark, docs, items, k=3, query_terms=40)  # several passes over the postings


def test_empty(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None), (2, "..")], [(1, "a")])


def test_probes_only_what_may_qualify():
    """Non-essential postings are looked up for documents that may still qualify, and for no others."""
    n = 2000
    rare, common = np.arange(0, 20, dtype=np.int32), np.arange(n, dtype=np.int32)
    lists = [(0, rare, np.full(len(rare), 9, np.int32)), (1, common, np.ones(n, np.int32))]
    block = lexical.Postings([*range(n)], np.full(n, 50, np.int32), lists, np.array([5000, 10]), n, 50 * n)
    best = lexical.Best(10)
    block.best(np.array([0, 1]), best)
    assert sorted(best.id) == [*range(10)]
    asked = []

    class Watched(dict):
        def __getitem__(self, t):
            asked.append(t)
            return dict.__getitem__(self, t)

    block.adds = Watched(block.adds)
    block.best(np.array([0, 1]), best)  # the threshold makes the common term non-essential
    assert asked.count(0) == 1 and asked.count(1) == 1
    asked.clear()
    block.best(np.array([1]), best)
    assert not asked  # can't reach the threshold at all
