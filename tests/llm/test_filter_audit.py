"""Inclusion and exclusion against filters that are applied one after another."""

import random
import re
from collections import defaultdict
from itertools import permutations

from textlake.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, lang string, part string, n string, known string", "doc_id long, quality int, toxic int, good string"


def brute(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    mark = defaultdict(lambda: [0, 0])
    for i, q, x, *_ in labels:
        if i is not None:
            mark[i][0] |= q == 1
            mark[i][1] |= x == 1
    parts = defaultdict(list)
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = dict(A=len(w) < 200, B=100 * len(set(w)) < 50 * len(w), C=100 * len(re.findall("[A-Z]", t)) > 3 * len(t), D=bool(re.search(r"[#$%&*|]", t)), E=i is not None and i > least[t])
        parts[lang or ""].append((f, *(mark[i] if i is not None else (0, 0))))
    out = []
    for part, rows in parts.items():
        removed = defaultdict(int)
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for k, x in enumerate(order):
                gone, stay = [r for r in left if r[0][x]], [r for r in left if not r[0][x]]
                redundant = sum(r[0][x] for r in rows) - len(gone)
                unique = sum(r[0][x] and sum(r[0].values()) == 1 for r in rows)
                removed[x] += len(gone)
                steps.append((part, "".join(order), k + 1, len(stay), len(gone), redundant, unique, sum(r[1] for r in gone), sum(r[2] for r in gone), x))
                left = stay
        out += [(*s[:-1], removed[s[-1]]) for s in steps]
    return sorted(out)


def check(spark, docs, labels):
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_all_orders(spark):
    rng = random.Random(5)
    docs = []
    for k in range(300):
        few = rng.random() < 0.3
        w = [f"w{rng.randrange(20 if few else 2000)}" for _ in range(rng.choice([3, 199, 200, 260]))]
        if rng.random() < 0.3:
            w = [x.upper() for x in w]
        docs.append((k, " ".join(w) + rng.choice(["", "", "#", " |", "\x0b\tz"]), rng.choice(["de", "en", None, ""]), "p", "n", "k"))
    docs += [(1000 + k, docs[k % 7][1], rng.choice(["de", "en", "fr"]), None, None, None) for k in range(80)]
    docs += [(5, docs[5][1], "en", None, None, None), (5, "other", "en", None, None, None), (5, docs[6][1], "de", None, None, None)]
    docs += [(None, docs[3][1], "en", None, None, None), (None, docs[3][1], "en", None, None, None), (None, None, None, None, None, None), (1, None, "x", None, None, None), (2000, "", "x", None, None, None)]
    docs += [(3000, "Long " * 300_000, "en", None, None, None), (3001, "日本É é\x85\xa0z " * 100, "en", None, None, None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1]), "g") for k in range(0, 1080, 2)] + [(4, 1, 0, None), (4, 0, 1, None), (None, 1, 1, None), (99_999, 1, 1, None)]
    check(spark, docs, labels)


def test_empty(spark):
    check(spark, [], [])
    check(spark, [(1, "a", "en", None, None, None)], [])
