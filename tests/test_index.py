"""Inverted index, hybrid search, batch answers, chunks as a table function."""

import math
from collections import Counter

import numpy as np
import pytest

from textlake.operators import chunking, inverted, retrieval, vectors

DOCS = [(k, " ".join(f"w{(k * 31 + i * i) % 97}" for i in range(5 + k % 40))) for k in range(200)] + [(900, None), (901, "  "), (902, "Rare RARE rare"), (None, "rare")]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    inverted.add(rows.where("doc_id < 100"), path)
    inverted.add(rows.where("doc_id >= 100 or doc_id is null"), path)
    return path


@pytest.mark.parametrize("own", [True, False])
def test_search_equals_scores_of_all_documents(spark, index, own):
    asked = [(1, "w1 W2 w2 nothing"), (2, "rare w5"), (3, "none at all"), (4, None)]
    got = inverted.search(spark, index, spark.createDataFrame(asked, "query_id long, text string"), 7, *((None, None) if own else ()))
    held = {i: Counter((t or "").lower().split()) for i, t in DOCS if i is not None and (t or "").strip()}
    mean = sum(sum(c.values()) for c in held.values()) / len(held) if own else 200
    df = Counter(t for c in held.values() for t in c)
    want = []
    for q, text in asked:
        scores = []
        for i, c in held.items():
            n, s = sum(c.values()), 0.0
            for t in (text or "").lower().split():
                weight = math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) if own else math.log(2)
                s += weight * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * n / mean))
            if s:
                scores.append((-round(s, 9), i))
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:7])]
    rows = sorted(got.collect(), key=lambda r: (r.query_id, r["rank"]))
    assert [(r.query_id, r.doc_id, r["rank"]) for r in rows] == [(q, i, r) for q, i, _, r in sorted(want, key=lambda w: (w[0], w[3]))]
    assert [r.score for r in rows] == pytest.approx([w[2] for w in sorted(want, key=lambda w: (w[0], w[3]))], abs=2e-9)


def test_search_reads_the_buckets_of_its_terms_only(spark, index):
    found = inverted.search(spark, index, spark.createDataFrame([(1, "w1 w2")], "query_id long, text string"), 5)
    text = plan(found)
    assert "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [bucket" in text
    assert "PushedFilters: [In(term" in text or "PushedFilters: [Or(EqualTo(term" in text or "In(term" in text
    assert "text#" not in text.split("== Physical Plan ==")[1].split("postings")[1]


def test_hybrid_fuses_both_lists(spark):
    points = spark.createDataFrame([(k, [1.0, k / 10], k % 2) for k in range(30)], "vec_id long, embedding array<float>, label int")
    lexical = spark.createDataFrame([(29, 1), (28, 2), (0, 3), (77, 4)], "vec_id long, rank int")
    out = vectors.hybrid(points, [1.0, 0.0], 3, lexical=lexical).collect()
    assert [r.vec_id for r in out] == [0, 29, 1] and out[0].rrf == pytest.approx(1 / 61 + 1 / 63) and out[1].dense_rank is None
    odd = vectors.hybrid(points, [1.0, 0.0], 3, {"label": 1}, lexical=lexical).collect()
    assert [r.vec_id for r in odd] == [1, 29, 3] and odd[1].lexical_rank == 1
    assert [r.vec_id for r in vectors.hybrid(points, [1.0, 0.0], 3).collect()] == [0, 1, 2]


def test_answers_of_many_equal_answers_of_one(spark):
    texts = [f"Passage {k} about {'law and legal regulation' if k % 3 else 'cooking'}. More of it follows here" for k in range(30)]
    rows = [(k, str(k), f"T{k}", "", t, "thai_law" if k % 3 else "cooking", "th", [float(x) for x in vectors.hash_embed([t])[0]]) for k, t in enumerate(texts)]
    points = spark.createDataFrame(rows, "id long, document_id string, document_title string, url string, content string, category string, language string, vector array<float>")
    asked = ["legal regulation of passage 4", "about cooking", "kubernetes docker passage 7", "zzz"]
    queries = spark.createDataFrame([(k, q, [float(x) for x in vectors.hash_embed([q])[0]]) for k, q in enumerate(asked)], "query_id long, text string, vector array<float>")
    got = {r.query_id: r for r in retrieval.answer_many(queries, points).collect()}
    for k, q in enumerate(asked[:3]):
        one = retrieval.answer(q, points)
        assert got[k].answer == one["answer"] and [c.document_id for c in got[k].citations] == [c["document_id"] for c in one["citations"]]
        assert got[k].confidence == pytest.approx(one["confidence"], abs=1e-6)
    assert len(got) == 4
    assert retrieval.answer_many(queries, points.limit(0)).select("answer").distinct().collect()[0].answer == retrieval.NOTHING


def test_chunks_in_sql_inherit_metadata(spark, sample_text):
    rows = [(1, sample_text, {"author": "a", "source": "old"}, "src"), (2, "  \n\n x", None, None), (3, None, {}, "s"), (4, "", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, metadata map<string,string>, source string")
    out = chunking.recursive_chunks(docs, 200, 20, inherit=("source",)).collect()
    mine = [r for r in out if r.doc_id == 1]
    assert len(mine) > 1 and all(len(r.content) <= 220 and r.token_count > 0 for r in out)
    assert all(r.metadata == {"author": "a", "source": "src", "chunk_index": str(r.chunk_index)} for r in mine)
    assert {r.doc_id for r in out} == {1, 2} and [r.metadata for r in out if r.doc_id == 2] == [{"chunk_index": str(r.chunk_index)} for r in out if r.doc_id == 2]
    docs.createOrReplaceTempView("to_cut")
    chunking.register(spark)
    again = spark.sql("SELECT doc_id, content FROM to_cut, LATERAL recursive_chunks(text, metadata, 200, 20)").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.content) for r in out)
    assert np.sum([len(r.content) for r in mine]) >= len(sample_text) * 0.9


def test_index_rows_are_terms_of_blocks_and_repeated_ids_one_document(spark, tmp_path, monkeypatch):
    rows = [(k, f"a b a w{k} Été x") for k in range(40)] + [(3, "a zz"), (3, "zz A q"), (50, None), (51, " \n"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    inverted.add(docs, f"{tmp_path}/one")
    stored = spark.read.parquet(f"{tmp_path}/one/postings")
    flat = sorted(tuple(r) for r in stored.selectExpr("term", "inline(docs)").collect())
    want = Counter((w, k) for k, t in rows if k is not None for w in (t or "").lower().split())
    longest = {k: max(len((t or "").split()) for i, t in rows if i == k) for k, _ in rows if k is not None}
    assert flat == sorted((w, k, n, max(len(t.split()) for i, t in rows if i == k and w in t.lower().split())) for (w, k), n in want.items())
    assert inverted.statistics(spark, f"{tmp_path}/one") == (40, sum(longest.values()) / 40)
    once = docs.where("doc_id <> 3")
    inverted.add(once, f"{tmp_path}/two")
    assert spark.read.parquet(f"{tmp_path}/two/postings").count() == len({w for w, k in want if k != 3})  # not a row for each document
    block = next(iter(once.select("doc_id", "text").toArrow().combine_chunks().to_batches()))
    monkeypatch.setattr(inverted, "BLOCK", 60)
    parts = list(inverted._blocks(block))
    assert len(parts) > 10 and [i for p in parts for i in p.column(0).to_pylist()] == block.column(0).to_pylist()
    assert sum(len(d) for p in parts for t, d in zip(*(c.to_pylist() for c in inverted._counted(*p.columns)), strict=True) if t) == sum(len(set(t.split())) for _, t in rows[:40]) - 5
