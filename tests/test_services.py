"""Fetching, crawling with plug-ins, objects, backfill, stored embeddings, logs and streams of sources."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textlake.operators import crawl, datasets, fetch, jobs, retrieval, storage, vectors
from textlake.plans import ingestion
from textlake.sources import archives, article
from textlake.sources import documents as S
from textlake.sources.objects import ObjectStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Network:
    """url -> list of answers, the last of which stays; an exception is raised."""

    def __init__(self, **answers):
        self.answers, self.asked = answers, []

    def get(self, url):
        self.asked.append(url)
        of = self.answers[url.rsplit("/", 1)[1]]
        got = of[min(self.asked.count(url), len(of)) - 1]
        if isinstance(got, Exception):
            raise got
        return got


PAGE = fetch.Response(200, "text/html", "<p>x</p>")


def test_attempts_wait_longer_each_time():
    waits = []
    net = Network(a=[TimeoutError(), ConnectionError(), PAGE], b=[OSError()], c=[fetch.Response(500, "text/html", "")], d=[fetch.Response(200, "image/png", "")])
    out = [fetch.attempt(net, f"http://h/{x}", sleep=waits.append) for x in "abcd"]
    assert [(o, n) for o, _, n in out] == [("ok", 3), ("network_error", 4), ("http_error", 1), ("not_html", 1)]
    assert waits == [1.0, 2.0, 1.0, 2.0, 4.0]


def test_fetch_is_polite_by_domain(spark):
    class Clock:
        now = 0.0

    def run(rows):
        waits = []
        clock = Clock()

        def sleep(s):
            waits.append(s)
            clock.now += s

        urls = spark.createDataFrame(rows, "url string, allowed boolean")
        return fetch.fetch(urls, Network(a=[PAGE], b=[PAGE], c=[PAGE]), sleep=sleep, clock=lambda: clock.now)

    out = {r.url: r for r in run([("http://h/a", True), ("http://h/a", True), ("http://h/b", True), ("http://g/c", False), (None, True)]).collect()}
    assert {u: r.outcome for u, r in out.items()} == {"http://h/a": "ok", "http://h/b": "ok", "http://g/c": "blocked"}
    assert out["http://g/c"].tries == 0 and out["http://h/a"].html == "<p>x</p>"
    assert run([]).count() == 0


def test_crawl_by_fetcher_and_sitemap(spark):
    page = lambda *links: fetch.Response(200, "text/html", "".join(f'<a href="{x}">{x}</a>' for x in links))
    net = Network(a=[page("/b", "/gone", "http://other.org/x")], b=[page("/a")], gone=[fetch.Response(404, "text/html", "")], s=[page("/b")], x=[PAGE])
    got = crawl.crawl(None, ["http://h.org/a"], fetch=lambda urls: fetch.pages(urls, net, wait=0.0, pause=0.0), spark=spark, sitemap=spark.createDataFrame([("http://h.org/s",), ("http://other.org/x",)], "url string"))
    assert sorted((r.url, r.depth) for r in got.collect()) == [("http://h.org/a", 0), ("http://h.org/b", 1), ("http://h.org/s", 0)]


def test_legacy_crawl(spark):
    rows = [("http://h.org/a/", '<title>A</title><a href="/b/">b</a><a href="/b#x">no</a>'), ("http://h.org/b", '<a href="http://o.org/c">c</a><a href="/d">d</a>same'), ("http://h.org/d", "far"), ("http://o.org/c", "other")]
    pages = spark.createDataFrame(rows, "url string, html string")
    out = crawl.crawl_legacy(pages, "http://h.org/a/", 1).collect()
    assert [(r.url, r.depth, r.title) for r in out] == [("http://h.org/a", 0, "A"), ("http://h.org/b", 1, "http://h.org/b")]
    assert {r.url for r in crawl.crawl_legacy(pages, "http://h.org/a", 2, follow_external=True).collect()} == {"http://h.org/a", "http://h.org/b", "http://h.org/d", "http://o.org/c"}


def test_sitemap_indexes_end(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    rows = [("i0", index("i1", "i0", "gone")), ("i1", index("i2")), ("i2", index("i3", "s")), ("i3", index("deep")), ("deep", "<urlset><url><loc>far</loc></url></urlset>"), ("s", "<urlset><url><loc> p1 </loc></url><url><loc>p2</loc></url><url><loc>p1</loc></url></urlset>")]
    found = crawl.discover_sitemaps(spark.createDataFrame(rows, "url string, xml string"), spark.createDataFrame([("i0",)], "url string"))
    assert sorted(r.url for r in found.collect()) == ["p1", "p2"]


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/o")
    assert store.list() == [] and not store.exists("a/b")
    assert store.put("a/b.txt", b"\x00\xff").endswith("/o/a/b.txt") and store.put_text("a/c/d", "é") and store.put("ab", b"z")
    assert store.get("a/b.txt") == b"\x00\xff" and store.get_text("a/c/d") == "é" and store.get("ab") == b"z"
    assert store.list() == ["a/b.txt", "a/c/d", "ab"] and store.list("a/") == ["a/b.txt", "a/c/d"] and store.list("a/b") == ["a/b.txt"]
    assert {r.key for r in store.read().collect()} == {"a/b.txt", "a/c/d", "ab"}
    store.delete("a/b.txt")
    store.delete("a/b.txt")
    assert not store.exists("a/b.txt") and not store.exists("a")
    for bad in ("../x", "/x", "a//b", "", "a/./b"):
        with pytest.raises(ValueError):
            store.put(bad, b"")
    with pytest.raises(KeyError):
        store.get("none")


class Web:
    def search(self, query, limit):
        return [{"title": "T", "url": "http://w/1", "content": "<b>found</b>  text"}, {"title": "E", "url": "http://w/2", "content": " "}]


def test_search_and_backfill(spark, tmp_path):
    points, store = storage.Collection(spark, f"file://{tmp_path}/p", "id"), ObjectStore(spark, f"file://{tmp_path}/o")
    for _ in range(2):
        rows = retrieval.search_and_backfill(spark, "q", Web(), points, store).collect()
        assert [r.url for r in rows] == ["http://w/1"]
    stored = points.read().collect()
    assert [(r.content, r.source_url, r.web_fallback, len(r.vector)) for r in stored] == [("found text", "http://w/1", True, vectors.DIM)]
    assert [store.get_text(k) for k in store.list("web_fallback/")] == ["found text"]

    class Broken:
        def upsert(self, rows):
            raise OSError("no store")

    assert retrieval.search_and_backfill(spark, "q", Web(), Broken()).count() == 1


def test_embed_job(spark, tmp_path):
    of = lambda name, key, rows: (c := storage.Collection(spark, f"file://{tmp_path}/{name}", key), c.create(rows))[0]
    docs = of("d", "doc_id", spark.createDataFrame([(1, "T", "some words " * 80, "pending"), (2, "U", "  ", "pending")], "doc_id long, title string, text string, status string"))
    chunks, points, notes = storage.Collection(spark, f"file://{tmp_path}/c", "vector_id"), storage.Collection(spark, f"file://{tmp_path}/p", "id"), []
    note = lambda i, s: notes.append((i, s))
    done = ingestion.embed_job(docs, chunks, points, 1, note=note)
    assert done["status"] == "indexed" and done["chunks"] == chunks.read().count() == points.read().count() > 1
    assert ingestion.embed_job(docs, chunks, points, 2, note=note)["status"] == "failed"
    with pytest.raises(KeyError):
        ingestion.embed_job(docs, chunks, points, 3, note=note)

    def broken(texts):
        raise OSError("model")

    with pytest.raises(Exception, match="model"):
        ingestion.embed_job(docs, chunks, points, 1, model=broken, retries=1, note=note)
    assert notes == [(1, "processing"), (1, "indexed"), (2, "processing"), (2, "failed"), (3, "processing"), (3, "failed"), (1, "processing"), (1, "retrying"), (1, "processing"), (1, "failed")]
    assert {r.doc_id: (r.status, r.chunk_count) for r in docs.read().collect()} == {1: ("indexed", done["chunks"]), 2: ("failed", 0)}


def test_results_and_logs(spark):
    hits = spark.createDataFrame([(1, 0.5, None, "c", 3)], "id int, score double, document_title string, content string, chunk_index int").withColumn("vector", F.array(F.lit(1.0)))
    row = vectors.as_results(hits).first()
    assert (row.id, row.document_id, row.document_title, row.content, row.metadata) == ("1", "", "", "c", {"chunk_index": "3"})
    answers = spark.createDataFrame([(1, "q", "a", 5), (2, "r", "b", 6)], "query_id int, query_text string, answer string, latency_ms int")
    cited = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "query_id int, index int, document_id string")
    assert {r.query_id: r.retrieved_doc_ids for r in jobs.query_logs(answers, cited).collect()} == {1: ["x", "y"], 2: []}


def test_writers_return_counts(spark, tmp_path):
    built = spark.createDataFrame([("t", "s", "en", 1)] * 3, "text string, source string, language string, word_count int")
    assert [datasets.write_dataset(built, f"file://{tmp_path}/{fmt}", fmt) for fmt in datasets.FORMATS] == [3, 3, 3]


def test_stream_of_a_source(spark, tmp_path):
    spark.dataSource.register(S.DocumentSource)
    stream = spark.readStream.format("textlake_documents").option("rows", "7").option("parts", "3").load()
    running = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/t").option("checkpointLocation", f"file://{tmp_path}/c").start()
    for _ in range(60):
        running.processAllAvailable()
        if spark.read.schema("title string").parquet(f"file://{tmp_path}/t").count() == 7:
            break
    running.stop()
    assert sorted(r.title for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [f"title {k}" for k in range(7)]


def test_broken_archive_records_and_site_rules(spark):
    data = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nxx\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert [r[-1] for r in archives.records(iter([data]))] == [b"ok"]
    html = '<article><p>' + "real text " * 20 + '</p><div class="a overlay">pay</div></article>'
    assert "pay" not in article.scrape("www.medium.com", html)[0] and "pay" in article.scrape("h.org", html)[0]
    page = '<meta name="date" content="2024-01-02"><meta name="parsely-pub-date" content="2024-03-04">'
    rows = spark.createDataFrame([(u, page) for u in ("http://medium.com/x", "http://h.org/x")], "url string, html string")
    assert [str(r.d)[:10] for r in rows.select(article.published(F.col("html"), F.col("url")).alias("d")).collect()] == ["2024-03-04", "2024-01-02"]
