"""Near-duplicates against brute-force components, with a crowded region."""

import math
import random
import re

from textlake.llm import graph, near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if docs[i][0] == docs[j][0] or both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(docs))], list(map(len, sets))


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = []
    for _ in range(320):  # one crowded region of edited copies, more than REGION
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(" ".join(t))
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        texts += [" ".join(t), " ".join(t).upper() + " "]
        t[rng.randrange(len(t))] = "edited"
        texts.append(" ".join(t))
    texts += ["", None, " \n ", "one", "ONE", "one two", "one\ttwo", "one two three", "dash 0 x"] + ["copy of this text here"] * 50
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    docs = corpus()
    docs.append((docs[7][0], "an id that repeats with another text in it"))
    want, sizes = components(docs)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs] + [(None, "one two three", "x")], "doc_id long, text string, component_id string")
    out = near_dup.near_duplicates(df).collect()
    assert len(out) == len(docs) + 1
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None) == sorted((d, n, c, c == d) for (d, _), n, c in zip(docs, sizes, want, strict=True))
    none = next(r for r in out if r.doc_id is None)
    assert none.component_id is None and none.kept


def test_single_links_in_a_crowded_family(spark, monkeypatch):
    """Classes with one true link, in a family that regions of this size cannot hold."""
    monkeypatch.setattr(near_dup, "REGION", 4)
    monkeypatch.setattr(near_dup, "CELL", 50)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]

    def edit(words, k):
        out = list(words)
        for at in rng.sample(range(len(out)), k):
            out[at] = f"x{rng.randrange(10**9)}"
        return out

    family = [edit(base, 2) for _ in range(300)]
    texts = family + [edit(w, 7) for w in family[:60]]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want, sizes = components(docs)
    out = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(d, n, c) for (d, _), n, c in zip(docs, sizes, want, strict=True)]


def test_prefix_join_against_all_pairs(spark, monkeypatch):
    """Rows of many components, by cells and rarity: no pair that is alike is left out, few others are met."""
    monkeypatch.setattr(near_dup, "CELL", 5)
    rng = random.Random(31)
    story = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(120):
        t = list(story)
        for at in rng.sample(range(len(t)), rng.choice([2, 3, 4, 12, 30])):
            t[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(t[: rng.choice([170, 185, 200])]))
    texts += ["a b c d e", "a b c d", "one", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    families = docs.selectExpr("doc_id as doc", "0L as family")
    apart = docs.selectExpr("doc_id as node", "doc_id as comp")
    none = spark.createDataFrame([], "a long, b long")
    sets = list(map(shingles, texts))
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if (both := len(sets[i] & sets[j])) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)}
    found = near_dup._settle(docs, families, apart, none, 85, 3)
    assert {(r.a, r.b) for r in found.collect()} == alike and len(alike) > 50
    again = spark.createDataFrame(sorted(alike), "a long, b long")
    assert near_dup._settle(docs, families, apart, again, 85, 3).count() == 0
    joined = docs.selectExpr("doc_id as node", "0L as comp")
    assert near_dup._settle(docs, families, joined, none, 85, 3) is None


def test_bits_lose_under_one_in_ten_billion():
    for percent in (80, 85):
        p, slack = (100 - percent) / 200, near_dup.bit_slack(percent)
        assert sum(math.comb(near_dup.VALUES, k) * p**k * (1 - p) ** (near_dup.VALUES - k) for k in range(slack + 1, near_dup.VALUES + 1)) < 1e-10 and slack < 48


def test_signature_filter_loses_under_one_in_a_billion():
    n = near_dup.VALUES
    need = math.ceil((0.85 - near_dup.SLACK) * n)
    assert sum(math.comb(n, k) * 0.85**k * 0.15 ** (n - k) for k in range(need)) < 1e-9


def test_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    out = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_common_sets(spark, monkeypatch):
    docs = [(i, ["a b c d e", "f g h i j", None, "  ", f"own text of {i} is here"][i % 5]) for i in range(60)] + [(None, "a b c d e")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted(map(str, near_dup.near_duplicates(df).collect()))
    monkeypatch.setattr(near_dup, "HOT", 3)
    assert sorted(map(str, near_dup.near_duplicates(df).collect())) == plain


def test_keep_one_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{(k * 7919 + i * i * 31) % 1009}" for i in range(60))
    docs = [(1, text(1), "a", 0), (2, text(1) + " more", "b", 0), (None, text(1), "c", 0), (None, text(2), "d", 0), (None, text(2), "d", 0), (None, text(2), "e", 0), (5, text(3), "f", 0), (5, text(3), "f", 0), (5, text(4), "g", 0), (6, None, "h", 0), (7, None, "i", 0), (None, None, "j", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, set_key string, component_id long")
    out = near_dup.keep_one(df)
    rows = out.collect()
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.set_key) for r in rows if r.doc_id in (1, 2, 6, 7)) == [(1, "a"), (6, "h"), (7, "i")]
    assert sum(r.doc_id == 5 for r in rows) == 1
    assert sorted(r.text or "" for r in rows if r.doc_id is None) == ["", text(2)]
    assert near_dup.keep_one(df.limit(0)).count() == 0
