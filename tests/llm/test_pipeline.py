"""The corpus pipeline, stage by stage, over small planted tables."""

import corpus_pipeline
from textlake.llm import queries


def words(k, n=70):
    return " ".join(f"w{(k * 7919 + i * i * 31) % 1009}" for i in range(n))


def test_stages(spark, tmp_path):
    item = words(999, 30)
    docs = [(i, words(i), "en", "s", 1) for i in range(40)]
    docs += [(100 + i, " ".join(f"X{(i * 17 + j * j) % 997}!!" for j in range(80)), "en", "s", 1) for i in range(20)]
    docs += [(200, words(3), "en", "s", 1), (201, f"{words(50)} {item} {words(51)}", "en", "s", 1), (202, words(60) + " token = abcdefghijklmnop", "en", "s", 1), (203, None, None, None, None)]
    at = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, at)
        rows = now.collect()
        seen[name] = {r.doc_id: r for r in rows}
        now = spark.createDataFrame(rows, now.schema)
        if name != "encode":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["quality"]) == {*range(40), 200, 201, 202}
    assert set(seen["near_dedup"]) == {*range(40), 201, 202}
    assert set(seen["decontaminate"]) == {*range(40), 202}
    assert seen["secrets"][202].text.endswith(" [SECRET]") and seen["secrets"][1].text == words(1)
    assert set(seen["encode"]) == {*range(40), 202} and all(len(r.ids) == 4 * r.n_tokens for r in seen["encode"].values())


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_dedup_drops_copies_with_an_added_block(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words[:100])), (2, " ".join(words)), (3, "another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_edge_cases(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, clashing columns, empty tables."""
    columns = "doc_id long, text string, set_key string, _base string, kept boolean, ids string, host long"
    long = " ".join(f"w{i % 5003}x{i % 7919}" for i in range(60_000))
    rows = [(1, words(1)), (1, words(1)), (1, words(2)), (None, words(3)), (None, words(3)), (4, words(3)), (5, None), (6, ""), (7, " \n"), (8, long), (9, long + " more"), (10, words(10) + " token = abcdefghijklmnop")]
    docs = spark.createDataFrame([(*r, "k", "b", True, "i", 1) for r in rows], columns)
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for name, some in (("all", docs), ("none", docs.limit(0))):
        at = f"file://{tmp_path}/{name}"
        some.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, at)
            assert now.columns == docs.columns, stage
        out = corpus_pipeline.run(spark, at)
        got = out.collect()
        assert "ids" in out.columns and len(got) == now.count()
        if name == "none":
            assert not got
            continue
        ids = [r.doc_id for r in got]
        assert sorted(i for i in ids if i is not None) == [1, 4, 8, 10] and ids.count(None) == 0
    # every stage alone takes rows that the first would drop
    for stage, f in corpus_pipeline.STAGES[1:]:
        assert {5, 6, 7} <= {r.doc_id for r in f(spark, docs, at).select("doc_id").collect()}, stage


def test_columns_of_any_name_and_type_pass_through(spark, tmp_path):
    names = ["_base", "_hot", "_spans", "_was", "_found", "_cut", "row", "near_dup_id", "set_key", "k", "of", "a b", "x.y"]
    columns = "doc_id long, text string, n_chars long, metadata map<string,string>, many array<struct<a:int,b:map<int,string>>>, " + ", ".join(f"`{n}` string" for n in names)
    row = lambda i, text: (i, text, len(text or ""), {"k": str(i), "l": "z"}, [(1, {2: "b"})], *names)
    rows = [row(1, words(1)), row(1, words(1)), row(2, words(2) + " token = abcdefghijklmnop"), row(3, words(1)), row(None, words(4)), row(None, words(4)), row(5, words(5))]
    docs = spark.createDataFrame(rows, columns)
    at = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, words(999, 30))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    now = docs
    for stage, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, at)
        assert now.schema.simpleString() == docs.schema.simpleString(), stage
        now = spark.createDataFrame(now.collect(), docs.schema)
    got = {r.doc_id: r for r in now.collect()}
    assert now.count() == 4 and set(got) == {1, 2, 5, None}
    for r in got.values():
        assert all(r[n] == n for n in names) and r.metadata["l"] == "z" and r.many[0].b == {2: "b"} and r.n_chars == len(r.text)
    assert got[2].text.endswith(" [SECRET]")
    assert corpus_pipeline.encode(spark, now, at).count() == 4
