"""Vector index against exact neighbours; language model against a count in Python and on held-out documents."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from textlake.operators import ann, language_model, vectors

DATA = "/root/testdata"
POINTS = "vec_id long, embedding array<float>"


def pairs(found):
    return {(r.query_id, r.vec_id) for r in found.collect()}


def test_recall_on_given_embeddings(spark, tmp_path):
    points = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    index = ann.VectorIndex(spark, f"file://{tmp_path}/v")
    index.fit(points)
    index.add(points)
    queries = points.where("vec_id % 20 = 0")
    want, got = pairs(vectors.knn(queries, points)), pairs(index.search(queries))
    centres, probes = index.centres()
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)
    assert probes < len(centres)  # even of vectors without any clusters, not all lists are read
    assert spark.read.parquet(f"{index.path}/lists").count() == points.count()
    assert pairs(index.search(queries, probes=len(centres))) == want


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    around = rng.normal(size=(20, 16))
    rows = [(k, (around[k % 20] + rng.normal(size=16) * 0.1).astype(float).tolist()) for k in range(1500)]
    hot = [float(x) for x in around[0]]
    rows += [(2000 + k, hot) for k in range(700)]  # a third of all rows are one vector
    odd = [(None, rows[0][1]), (3000, None), (3001, [0.0] * 16), (3002, [1.0]), (3003, [float("nan")] * 16), (3004, []), (3005, [None] * 16)]
    points = spark.createDataFrame(rows + odd + [(5, rows[5][1])], POINTS)
    index = ann.VectorIndex(spark, f"file://{tmp_path_factory.mktemp('ann')}/v")
    index.fit(points, lists=20)
    index.add(points.where("vec_id < 1000 OR vec_id IS NULL"))
    index.add(points.where("vec_id >= 1000"))
    return points, index


def test_few_lists_are_read_where_vectors_cluster(spark, clustered):
    points, index = clustered
    queries = points.where("vec_id IN (7, 8, 2100, 3001)")
    sound = points.where("vec_id < 3000")
    found = index.search(queries, 5)
    assert pairs(found) == pairs(vectors.knn(queries.where("vec_id < 3000"), sound, 5))
    assert index.centres()[1] <= 4
    assert "PartitionFilters: [isnotnull(list" in (plan := found._jdf.queryExecution().toString()) or "PartitionFilters: [list" in plan
    assert spark.read.parquet(f"{index.path}/lists").count() == 2201  # what has no cosine is left out, a repeated row is not


def test_blocks_of_queries_and_ties(spark, clustered, monkeypatch):
    points, index = clustered
    queries = points.where("vec_id BETWEEN 100 AND 260 OR vec_id = 2003")
    whole = sorted(map(tuple, index.search(queries, 4).collect()))
    monkeypatch.setattr(ann, "BLOCK", 5)
    assert sorted(map(tuple, index.search(queries, 4).collect())) == whole
    hot = [r for r in whole if r[0] == 2003]
    assert [r[1] for r in sorted(hot, key=lambda r: r[3])] == [2000, 2001, 2002, 2004]  # equal scores by id, without itself


def test_nothing_to_index(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None)], [(1, [0.0, 0.0])])):
        points = spark.createDataFrame(rows, POINTS)
        index = ann.VectorIndex(spark, f"file://{tmp_path}/{k}")
        index.fit(points)
        index.add(points)
        assert index.search(spark.createDataFrame([(1, [1.0, 0.0])], POINTS)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0])], POINTS)
    index = ann.VectorIndex(spark, f"file://{tmp_path}/one")
    index.fit(one)
    index.add(one)
    assert index.search(one).collect() == [] and len(index.search(one, itself=True).collect()) == 1


TEXTS = [
    (1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chat et le chien", "fr"), (4, None, "en"), (5, " \n ", "de"),
    (6, "the dog Und the hund", None), (7, "qqq", ""), (8, "x" * 200_000, "en"), (9, "the cat and the dog", "en"), (9, "le chien", "fr"), (None, "die katze", "de"), (10, "日本 é́ \U0001f600", "de"),
]


def grams_of(text):
    return [f" {w} "[i : i + 3] for w in (text or "").lower().split() for i in range(len(w))]


@pytest.mark.parametrize(("kept", "words"), [(50_000, 20_000), (12, 3), (12, 0)])
def test_model_equals_counts(spark, monkeypatch, kept, words):
    monkeypatch.setattr(language_model, "WORDS", words)
    docs = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, lang string, gram string")
    got = language_model.detect(docs, language_model.fit(docs, grams=kept)).collect()
    counts = {lang: Counter(g for _, t, x in TEXTS if x == lang for g in grams_of(t)) for lang in ("de", "en", "fr")}
    total = sum(counts.values(), Counter())
    known = sorted(total, key=lambda g: (-total[g], g.encode()))[:kept]
    weight = {lang: {g: math.floor(1000 * math.log(c[g] + 1)) for g in known} for lang, c in counts.items()}
    cost = {lang: math.floor(1000 * math.log(sum(c.values()) + len(total))) for lang, c in counts.items()}
    want = []
    for i, t, _ in TEXTS:
        grams = grams_of(t)
        best = sorted((-sum(weight[x].get(g, 0) - cost[x] for g in grams), x) for x in counts)
        want.append((i, len(grams), best[0][1], best[1][0] - best[0][0]) if grams else (i, 0, None, None))
    key = str
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_no_labels_no_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_model.detect(docs, language_model.fit(docs)).collect()] == [(1, 9, None, None)]
    assert language_model.detect(docs.limit(0), language_model.fit(docs.limit(0))).collect() == []
    alone = docs.withColumn("lang", F.lit("en"))
    assert [tuple(r) for r in language_model.detect(alone, language_model.fit(alone)).collect()] == [(1, 9, "en", None)]


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = F.pmod(F.xxhash64("text"), F.lit(5)) == 0  # copies of a text are on one side
    found = language_model.detect(docs.where(out), language_model.fit(docs.where(~out)))
    rows = found.join(docs.select("doc_id", "lang", "text"), "doc_id").where(F.size(F.split("text", " ")) >= 5)
    right = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("language")).cast("int")).alias("share")).collect()}
    print({k: (r.n, r.share) for k, r in right.items()})
    assert len(right) == 4 and all(r.share >= 0.97 for r in right.values())


def test_exact_search_makes_a_bounded_number_of_scores_at_a_time(spark, monkeypatch):
    """However large the batch: slices of points, ties by vec_id across them, and points without a cosine left out."""
    made = []
    old = vectors.Best._add
    monkeypatch.setattr(vectors.Best, "CELLS", 60)
    monkeypatch.setattr(vectors.Best, "_add", lambda self, names, m: (made.append(len(self.ids) * len(m)), old(self, names, m)))
    rng = np.random.default_rng(3)
    m = rng.normal(size=(500, 8))
    m[100:400:7] = m[7]
    m[11] = 0
    ids = np.arange(20)
    best = vectors.Best(ids, m[:20], 5, False)
    best.add(np.arange(500), pd.Series(list(m)))
    with np.errstate(all="ignore"):
        unit = m / np.linalg.norm(m, axis=1)[:, None]
    want = []
    for q in range(20):
        score = np.round(unit @ unit[q], 12)
        order = [int(x) for x in np.lexsort((np.arange(500), -score)) if x != q and np.isfinite(score[x])][:5]
        want += [(q, x) for x in order]
    out = best.frame()
    assert list(zip(out.query_id, out.vec_id)) == want and max(made) <= 60


def test_vector_index_search_sends_no_vectors_to_the_driver(spark, tmp_path, monkeypatch):
    """Only the centres come to the driver; a crowded list meets its queries in pieces and blocks with the same result."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 8))
    m[50:250] = m[50]
    points = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "vec_id long, embedding array<float>")
    index = ann.VectorIndex(spark, str(tmp_path / "v"))
    index.fit(points, lists=4)
    index.add(points)
    monkeypatch.setattr(ann, "BLOCK", 9)
    monkeypatch.setattr(ann, "PIECE", 30)
    centres = index.centres()
    monkeypatch.setattr(index, "centres", lambda: centres)
    with monkeypatch.context() as held:
        held.setattr(type(points), "collect", lambda self: pytest.fail("rows came to the driver"))
        found = index.search(points.where("vec_id % 10 = 0"), probes=4)
    want = vectors.knn(points.where("vec_id % 10 = 0"), points)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert key(found) == key(want)


def test_distinct_words_of_a_block_are_cut_once(spark, monkeypatch):
    """Words are counted where the texts are, and no row is made for a word or trigram of running text."""
    docs = spark.createDataFrame([(k, f"the cat and the dog {k % 3}" * 3, ("en", "de")[k % 2]) for k in range(60)], "doc_id long, text string, lang string").coalesce(1)
    model = language_model.fit(docs)
    found = language_model.detect(docs, model)
    assert "Generate" not in found._jdf.queryExecution().toString()
    whole = sorted(map(tuple, found.collect()))
    batch = docs.selectExpr("lang", "text").toArrow().combine_chunks().to_batches()[0]
    rows = [r for b in language_model._word_counts(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(rows) == len({r[:2] for r in rows}) and sum(r[2] for r in rows) == sum(len(t.split()) for t in batch.column(1).to_pylist())
    monkeypatch.setattr(language_model, "WORDS", 2)
    assert sorted(map(tuple, language_model.detect(docs, model).collect())) == whole
