"""Chunking, dedup, search, ranking, storage, jobs, datasets, retrieval and crawl operators on small cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlake.config import DatasetConfig
from textlake.operators import chunking, crawl, datasets, dedup, jobs, ranking, retrieval, storage, vectors


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def model_split(text, size, overlap, separators):
    """String-building model of the recursive splitter."""
    head, *rest = separators
    out, held = [], ""
    for piece in text.split(head) if head else list(text):
        longer = f"{held}{head}{piece}" if held else piece
        if len(longer) <= size:
            held = longer
        else:
            out += [held] if held else []
            held = ""
            if len(piece) > size:
                out += model_split(piece, size, overlap, rest)
            else:
                held = piece
    out += [held] if held else []
    if not overlap:
        return out
    joined = [p[-overlap:] + head + c for p, c in zip(out, out[1:], strict=False)]
    return out[:1] + [j if len(j) <= size + overlap else c for j, c in zip(joined, out[1:], strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=120), st.integers(1, 20), st.integers(0, 8))
def test_recursive_split(text, size, overlap):
    assert chunking.split_recursive(text, size, overlap) == model_split(text, size, overlap, chunking.SEPARATORS)


def test_recursive_chunks(spark, sample_text):
    out = chunking.recursive_chunks(docs_of(spark, ["One short sentence.", sample_text * 5, "   ", None]), 200, 20).collect()
    assert [(r.chunk_index, r.content) for r in out if r.doc_id == 0] == [(0, "One short sentence.")]
    assert sum(r.doc_id == 1 for r in out) > 1 and all(len(r.content) <= 250 and r.token_count > 0 for r in out)
    assert not [r for r in out if r.doc_id > 1]


def test_word_and_fixed_chunks(spark):
    out = chunking.word_chunks(docs_of(spark, [" ".join(map(str, range(10))), "", "a"]), 4, 1).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.content, r.start_word, r.end_word) for r in out] == [(0, "0 1 2 3", 0, 4), (0, "3 4 5 6", 3, 7), (0, "6 7 8 9", 6, 10), (2, "a", 0, 1)]
    with pytest.raises(ValueError):
        chunking.word_chunks(docs_of(spark, ["a"]), 4, 4)
    assert [r.content for r in chunking.fixed_chunks(docs_of(spark, ["abcdef"]), 4, 2).collect()] == ["abcd", "cdef", "ef"]


def greedy_model(texts, kind="char", min_chars=50):
    """Documents in order; one that shares a band with a kept one is a duplicate."""
    kept, out = set(), []
    shingle = dedup.char_shingles if kind == "char" else dedup.word_shingles
    for t in texts:
        if len(t) < min_chars:
            out.append(False)
            continue
        s = dedup.minhash(shingle(t))
        own = {(b, tuple(s[b * 16 : b * 16 + 16].tolist())) for b in range(8)}
        out.append(bool(own & kept))
        if not out[-1]:
            kept |= own
    return out


def test_greedy_dedup(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(6)]
    texts = []
    for _ in range(80):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    texts += ["short", "short", ""]
    got = [r.is_duplicate for r in dedup.greedy_marks(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == greedy_model(texts)
    assert dedup.deduplicate(docs_of(spark, texts), "drop").count() == got.count(False)
    assert dedup.deduplicate(docs_of(spark, []), "mark").count() == 0


def test_long_chains(spark, monkeypatch):
    """Rounds and the ordered pass agree on chains of collisions, where each document collides with the next only."""
    rows = [(i, i.to_bytes(16, "big"), [i, i + 1, -i - 1]) for i in range(12)] + [(20 + k, (20 + k).to_bytes(16, "big"), [100, 200 + k]) for k in range(5)]
    signed = spark.createDataFrame(rows, "doc_id long, same binary, bands array<long>")
    monkeypatch.setattr(dedup, "banded", lambda docs, kind: signed)
    docs = docs_of(spark, [str(r[0]) for r in rows]).select(F.col("text").cast("long").alias("doc_id"), "text")
    want = [i % 2 == 1 for i in range(12)] + [k > 0 for k in range(5)]
    for finish in (0, 9, 1000):
        assert [r.is_duplicate for r in dedup.greedy_marks(docs, min_chars=0, finish=finish).orderBy("doc_id").collect()] == want


def test_like_any_reads_stored_once_and_meets_the_threshold(spark):
    """However many queries there are, stored rows are signed once; 109 equal values of 128 are enough, 108 are not, wherever they differ."""
    own = lambda k: [k * 1000 + i for i in range(128)]
    apart = lambda k, n, step: [-1 - v if i % step == 0 and i // step < n else v for i, v in enumerate(own(k))]
    planted = [(9000 + k, [v % 2**32 for v in apart(k, n, step)]) for k, (n, step) in enumerate([(0, 1), (19, 1), (20, 1), (19, 6), (20, 6)])]
    rows = [(k, own(k)) for k in range(2100)] + [(2, own(3000)), *planted]
    queries = spark.createDataFrame(rows[:2100], "doc_id long, signature array<long>")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stored = spark.createDataFrame(rows, "doc_id long, signature array<long>").mapInArrow(counted, "doc_id long, signature array<long>")
    found = dedup.like_any(queries, stored)
    assert [r.query_id for r in found.where("is_duplicate").orderBy("query_id").collect()] == [0, 1, 3]
    assert found.count() == 2100 and seen.value == len(rows)


def test_like_any_and_new_only(spark):
    texts = ["the same long text " * 10] * 2 + ["something else entirely, really " * 9]
    signed = dedup.signatures(docs_of(spark, texts))
    assert [r.is_duplicate for r in dedup.like_any(signed, signed).orderBy("query_id").collect()] == [True, True, False]
    stored = spark.createDataFrame([("x",)], "content_hash string")
    assert sorted(r.doc_id for r in dedup.new_only(docs_of(spark, texts), stored).collect()) == [0, 2]


def points(spark, n=20, dim=8):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=dim)], i % 3) for i in range(n)], "vec_id long, embedding array<float>, label int")


def test_search(spark):
    p = points(spark)
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in p.collect()}
    q = [1.0] * 8
    cos = {i: v @ np.ones(8) / np.linalg.norm(v) / np.sqrt(8) for i, v in rows.items()}
    best = sorted(cos, key=lambda i: (-cos[i], i))
    assert [r.vec_id for r in vectors.top_k(p, q, 3).collect()] == best[:3]
    assert [r.vec_id for r in vectors.search(p, q, 2, {"label": 9}).collect()] == best[:2]
    assert {r.label for r in vectors.top_k(p, q, 3, {"label": 1}).collect()} == {1}
    assert [r.vec_id for r in vectors.hybrid(p, q, 4).collect()] == best[:4]
    near = vectors.knn(p.where("vec_id < 2"), p, 3).where("query_id = 0").orderBy("rank").collect()
    sim = {i: rows[0] @ v / np.linalg.norm(rows[0]) / np.linalg.norm(v) for i, v in rows.items() if i}
    assert [r.vec_id for r in near] == sorted(sim, key=lambda i: (-sim[i], i))[:3]
    v = vectors.embed(spark.createDataFrame([("a b",), ("",)], "text string")).collect()
    assert np.linalg.norm(v[0].vector) == pytest.approx(1) and not any(v[1].vector)


def test_bm25_and_rerank(spark):
    df = spark.createDataFrame([("a a b", "a b a c"), ("x", "a"), ("a", "")], "q string, d string")
    out = df.select(ranking.bm25(F.col("q"), F.col("d")).alias("new"), ranking.bm25_legacy(F.col("q"), F.col("d")).alias("old")).collect()
    part = lambda f, n, avg: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / avg))
    assert out[0].new == pytest.approx(np.log(2) * (2 * part(2, 4, 200) + part(1, 4, 200)))
    assert out[0].old == pytest.approx(part(2, 4, 100) + part(1, 4, 100))
    assert out[1].new == out[2].old == 0
    rows = spark.createDataFrame([(0, p, v, b) for p, v, b in [(0, 0.5, 1.0), (1, 0.9, 0.0), (2, 0.5, 1.0)]], "query_id int, pos int, vector_score double, bm25_score double")
    assert [r.pos for r in ranking.rerank(rows, 3).orderBy("rank").collect()] == [1, 0, 2]
    assert [r.pos for r in ranking.rerank_legacy(rows, 2).orderBy("rank").collect()] == [1, 0]


def test_storage(spark, tmp_path):
    p = points(spark, 5)
    t = storage.Collection(spark, f"file://{tmp_path}/c")
    assert not t.exists()
    t.create(p)
    t.upsert(p.where("vec_id = 1").withColumn("label", F.lit(50)))
    t.delete(p.where("vec_id = 2"))
    assert sorted((r.vec_id, r.label) for r in t.read().collect()) == [(0, 0), (1, 50), (3, 0), (4, 1)]
    d, c, v = storage.delete_document(docs_of(spark, ["a", "b"]), docs_of(spark, ["a", "b"]), docs_of(spark, ["a", "b"]), spark.createDataFrame([(0,)], "doc_id long"))
    assert d.count() == c.count() == v.count() == 1
    with pytest.raises(KeyError):
        storage.get(p, "vec_id", 99)
    chunks = chunking.fixed_chunks(docs_of(spark, ["abcd"]), 2, 0)
    assert [x.content for x in storage.with_chunks(docs_of(spark, ["abcd"]), chunks).first().chunks] == ["ab", "cd"]


def test_jobs(spark):
    logs = spark.createDataFrame([("1", " q ", 5, [("c", 1.0), (" ", 1.0)]), ("2", "q", 1, [("c", 1.0)]), ("3", "q", None, None), ("4", " ", 4, [("c", 1.0)])], "id string, query_text string, feedback_score int, retrieved_chunks array<struct<content:string,score:double>>")
    r = jobs.feedback_stats(logs).first()
    assert (r.total_logs, r.labelled_logs, r.positive_pairs, r.negative_pairs, r.unlabelled_logs, r.ready_to_train) == (4, 3, 6, 1, 1, False)
    assert [(x.query, x.chunk) for x in jobs.training_pairs(logs).collect()] == [("q", "c")]
    assert not jobs.ready_to_train(jobs.training_pairs(logs))
    feedback = spark.createDataFrame([("3", 2, 1), ("3", 4, 2), ("9", 5, 1)], "query_id string, score int, ts int")
    assert {x.id: x.feedback_score for x in jobs.with_feedback(logs, feedback).collect()}["3"] == 4


def test_datasets(spark, tmp_path, sample_text):
    docs = docs_of(spark, [sample_text, sample_text, "short", " ".join(f"w{i}" for i in range(60))])
    config = DatasetConfig(min_words=20)
    built = datasets.build(docs, config)
    assert sorted(r.doc_id for r in built.collect()) == [0, 3]
    assert datasets.counts(docs, built, config).first().asDict() == {"total": 4, "filtered": 1, "deduplicated": 1, "written": 2}
    for fmt in datasets.FORMATS:
        datasets.write_dataset(built, f"file://{tmp_path}/{fmt}", fmt)
        assert datasets.read_dataset(spark, f"file://{tmp_path}/{fmt}", fmt).count() == 2
    with pytest.raises(ValueError):
        datasets.write_dataset(built, f"file://{tmp_path}/x", "csv")


def test_retrieval(spark):
    rows = [("1", "python code and docker", "tech_docs", "en"), ("2", "thai news today", "thai_news", "th"), ("3", "other words", "general", "en")]
    p = spark.createDataFrame([(i, c, f"T{i}", i, None, k, lang) for i, c, k, lang in rows], "id string, content string, document_title string, document_id string, url string, category string, language string")
    p = vectors.embed(p, "content")
    found = retrieval.retrieve("python docker", p).collect()
    assert [r.id for r in found] == ["1"] and found[0].intent == "tech_docs"
    assert len(retrieval.retrieve("zzz", p).collect()) == 3

    class Web:
        def search(self, query, limit):
            return [{"title": "W", "url": "u", "content": "found online. more"}, {"title": "B", "url": "v", "content": " "}]

    low = retrieval.answer("zzz", p, web=Web())
    assert low["used_web_fallback"] and low["answer"] == "found online" and low["citations"][0]["title"] == "W"
    assert not retrieval.answer("python docker", p)["used_web_fallback"]
    with pytest.raises(ValueError):
        retrieval.validate("", 5)
    with pytest.raises(ValueError):
        retrieval.validate("q", 51)


def test_crawl(spark):
    link = lambda *u: "".join(f'<a href="{x}">' for x in u)
    site = {"https://e.org/": link("/a", "/b", "https://o.org/x"), "https://e.org/a": link("/c") + "a", "https://e.org/b": link("/c") + "a", "https://e.org/c": link("/d"), "https://e.org/d": "end", "https://o.org/x": "other"}
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    got = crawl.crawl(pages, ["https://e.org/"], 2, 50)
    assert [(r.url, r.depth) for r in got.collect()] == [("https://e.org/", 0), ("https://e.org/a", 1), ("https://e.org/c", 2)]
    assert "https://o.org/x" in {r.url for r in crawl.crawl(pages, ["https://e.org/"], 1, 50, True).collect()}


def test_ingestion(spark, sample_text):
    from textlake.plans import ingestion
    from textlake.sources import registry

    texts = [sample_text, sample_text, sample_text.replace("fox", "cat", 1), "short", "w " * 100]
    done = ingestion.outcomes(docs_of(spark, texts), min_words=20)
    assert ingestion.stats(done).first().asDict() == {"total": 5, "rejected": 2, "near_dup": 0, "exact_dup": 1, "indexed": 2}
    near = ingestion.outcomes(docs_of(spark, texts), min_words=20, near="drop")
    assert ingestion.stats(near).first().near_dup >= 1
    assert {len(r.vector) for r in ingestion.points(done).collect()} == {384}
    rows = spark.createDataFrame([(1, "https://arxiv.org/x", None, {"category": "no", "k": "v"})], "id int, url string, language string, metadata map<string,string>")
    r = ingestion.enrich(rows, registry.sources(spark)).first()
    assert (r.category, r.language, r.source_type) == ("academic_ai", "unknown", "web") and r.metadata["category"] == "academic_ai" and r.metadata["k"] == "v"


def test_job_events(spark):
    log = jobs.event(spark, "a", "running", 5, 10).unionByName(jobs.event(spark, "b", "success"))
    assert {r.job_id: r.progress for r in log.collect()} == {"a": 50, "b": 100}
    with pytest.raises(ValueError):
        jobs.event(spark, "a", "odd")


def test_signing_holds_one_text_of_a_batch_at_a_time(spark, monkeypatch):
    """Texts of an Arrow batch are not all Python objects at once, and long words are not remembered."""
    words = dedup._WordHashes()
    monkeypatch.setattr(words, "MOST", 3, raising=False)
    assert [words[w] for w in ("a", "b", "c", "d", "x" * 65)] == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in ("a", "b", "c", "d", "x" * 65)]
    assert set(words) == {"d"}
    column = pa.array(["one", None, "two"])
    each = dedup._each(column)
    assert iter(each) is each and list(each) == column.to_pylist()
