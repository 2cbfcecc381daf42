"""Decontamination: exact leaks are all found, edited ones up to the limit with high recall, clean texts left alone."""

import random
import time
import tracemalloc

from textlake.llm import decontam


def edited(rng, words, k, vocab):
    out = list(words)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(vocab)
        elif kind == 1:
            out.insert(at, rng.choice(vocab))
        else:
            del out[at]
    return out


def distance(item, text):
    """Least edit distance of item to a stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def make(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(12, 55))] for _ in range(n)]
    return rng, vocab, items


def test_recall_and_exactness():
    rng, vocab, items = make(1)
    tables = decontam.Tables(list(enumerate(decontam.item_words([" ".join(w).encode() for w in items]))))
    for share, least in ((0.0, 1.0), (0.1, 0.99), (0.2, 0.93)):
        texts, want = [], []
        for k, w in enumerate(items):
            body = [rng.choice(vocab) for _ in range(50)] + edited(rng, w, int(share * len(w)), vocab) + [rng.choice(vocab) for _ in range(30)]
            texts.append(" ".join(body).upper().encode())
            want.append((k, body))
        found = tables.scan(texts)
        hit = 0
        for (k, body), leaks in zip(want, found, strict=True):
            hit += any(item == k for item, *_ in leaks)
            for item, start, end, cost in leaks:
                assert cost == distance(items[item], body[max(0, start - 12) : end + 12]) <= 0.2 * len(items[item]) and 0 <= start < end <= len(body)
        assert hit >= least * len(items), (share, hit)


def test_long_items():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(3000)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (100, 200, 400) for _ in range(8)]
    tables = decontam.Tables(list(enumerate(decontam.item_words([" ".join(w).encode() for w in items]))))
    bodies = [[rng.choice(vocab) for _ in range(60)] + edited(rng, w, len(w) // 5, vocab) + [rng.choice(vocab) for _ in range(60)] for w in items]
    found = tables.scan([" ".join(b).encode() for b in bodies])
    for k, (body, leaks) in enumerate(zip(bodies, found, strict=True)):
        assert [(item, cost) for item, _, _, cost in leaks] == [(k, distance(items[k], body))]


def test_one_long_item_among_short_ones():
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(5000)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (50_000, *[20] * 200)]
    texts = [edited(rng, items[0], 50, vocab), items[0], items[0][:30_000], [*items[7], "and", *items[9]], edited(rng, items[0], 11_000, vocab)]
    began = time.process_time()
    tracemalloc.start()
    tables = decontam.Tables(list(enumerate(decontam.item_words([" ".join(w).encode() for w in items]))))
    found = tables.scan([" ".join(w).encode() for w in texts])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[(item, cost) for item, _, _, cost in leaks] for leaks in found[1:4]] == [[(0, 0)], [], [(7, 0), (9, 0)]]
    assert [item for item, *_ in found[0]] == [0] and 30 < found[0][0][3] <= 50
    assert peak < 400e6 and time.process_time() - began < 240, (peak, time.process_time() - began)


def test_pairs_that_many_items_share(monkeypatch):
    items = [["a", "b"] * 6 + [f"x{k}"] for k in range(200)]
    texts = [" ".join(["a", "b"] * 500).encode(), " ".join([*items[5], "z", *items[150]]).encode()]
    tables = decontam.Tables(list(enumerate(decontam.item_words([" ".join(w).encode() for w in items]))))
    monkeypatch.setattr(decontam, "HITS", 1000)
    few = tables.scan(texts)
    monkeypatch.setattr(decontam, "HITS", 10**9)
    assert few == tables.scan(texts) and len(few[0]) == 200 and [(i, c) for i, *_, c in few[1] if not c] == [(5, 0), (150, 0)]


def test_blocks(spark, monkeypatch):
    rng, vocab, items = make(6, 12)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"in {' '.join(w)} out") for k, w in enumerate(items[:6])] + [(99, "none here")], "doc_id long, text string")
    whole = sorted(decontam.leaks(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert sorted(decontam.leaks(docs, bench).collect()) == whole and len(whole) == 6
    assert [r.doc_id for r in decontam.drop_leaks(docs, bench).collect()] == [99]


def test_repeated_one_word_items():
    tables = decontam.Tables(list(enumerate(decontam.item_words([b"Foo", b"foo", b"bar", b"foo"]))))
    assert tables.scan([b"a FOO and foo", b"none"]) == [[(0, 1, 2, 0), (1, 1, 2, 0), (3, 1, 2, 0)], []]


def test_queries(spark):
    rng, vocab, items = make(2, 20)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "lone"), (93, "two words"), (3, " ".join(items[3]))], "item_id long, text string")
    clean = " ".join(rng.choice(vocab) for _ in range(400))
    rows = [(1, f"{clean} {' '.join(items[5])} {clean}"), (2, clean), (3, None), (4, ""), (5, "has two Words in it"), (6, "a LONE one"), (None, " ".join(items[7])), (1, " ".join(items[6])), (8, "in " * 60_000 + " ".join(items[8]))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 5), (1, 6), (5, 93), (6, 92), (None, 7), (8, 8)}
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == len(rows)
