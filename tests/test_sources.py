"""Sources, registry and streaming on small cases."""

import gzip

from pyspark.sql import functions as F

from textlake.functions import urls as U
from textlake.sources import documents as S
from textlake.sources import registry
from textlake.streaming import ingest


def test_projections(spark, tmp_path):
    df = spark.createDataFrame([(1, "body text", "T", 2.5), (2, "  ", None, None)], "n int, text string, title string, x double")
    out = S.from_dataset(df, "hub", title="title").collect()
    assert len(out) == 1 and out[0].title == "T" and out[0].metadata == {"n": "1", "x": "2.5"} and out[0].source_type == "huggingface"
    assert S.from_database(df.withColumnRenamed("text", "body"), "db").first().text == "body text"
    assert S.from_text(spark, [("a", "b")]).first().source_type == "api"
    (tmp_path / "f.txt").write_bytes(b"ok \xff")
    assert S.from_files(spark, f"file://{tmp_path}/f.txt").first().text == "ok �"
    assert S.from_pdf(spark, f"file://{tmp_path}/f.txt", lambda b: "page").first().title == "f"

    def fails(b):
        raise ValueError

    assert S.from_pdf(spark, f"file://{tmp_path}/f.txt", fails).count() == 0


def test_warc(spark, tmp_path):
    def record(kind, url, html):
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + html.encode()
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    long = "<title>T</title><script>no</script>" + "word " * 40
    data = record("response", "u1", long) + record("request", "u2", long) + record("response", "u3", "short") + record("response", "u4", long)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    out = S.from_common_crawl(spark, f"file://{tmp_path}/*.warc*").collect()
    assert sorted(r.url for r in out) == ["u1", "u1", "u4", "u4"] and all(r.title == "T" and "no" not in r.text.split() for r in out)
    assert S.from_common_crawl(spark, f"file://{tmp_path}/*", 1).count() == 2


def test_feeds_and_sitemaps(spark):
    rss = "<rss><item><title><![CDATA[A]]></title><link>http://a</link><pubDate>Mon, 06 May 2024 07:08:09 +0000</pubDate><description>&lt;b&gt;x <b>y</b></description></item><item><title>no link</title></item><item><title>C</title><guid>g</guid></item></rss>"
    out = S.feed_items(spark.createDataFrame([("f", rss)], "feed_url string, xml string")).collect()
    assert [(r.title, r.url) for r in out] == [("A", "http://a"), ("C", "g")] and out[0].published_at.year == 2024
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T</title><link rel="self" href="http://s"/><link href="http://e"/><updated>2024-01-02T03:04:05Z</updated><author><name>Ann</name></author></entry></feed>'
    rss = '<rss xmlns:dc="http://d"><channel><item><title>one</title><link>http://1</link><dc:creator>Bob</dc:creator></item></channel></rss>'
    out = S.feed_items(spark.createDataFrame([("g", atom), ("h", rss), ("bad", "<rss><item>"), ("n", None)], "feed_url string, xml string")).collect()
    assert [(r.feed_url, r.title, r.url, r.author) for r in out] == [("g", "T", "http://e", "Ann"), ("h", "one", "http://1", "Bob")] and out[1].published_at is None
    xml = spark.createDataFrame([('<urlset xmlns="http://s"><url><loc> http://a </loc></url><url><loc>http://b</loc></url></urlset>',)], "xml string")
    assert [r.url for r in S.sitemap_urls(xml).collect()] == ["http://a", "http://b"]


def test_data_source(spark):
    spark.dataSource.register(S.DocumentSource)
    assert spark.read.format("textlake_documents").option("rows", 5).load().count() == 5


def test_registry(spark):
    assert registry.categories(spark).count() == 7 and registry.sources(spark).count() == 23
    df = spark.createDataFrame([("https://www.matichon.co.th/x", ""), ("https://a.b", ""), ("https://a.b", "given")], "url string, given string")
    assert [r.category for r in registry.resolve_category(df, registry.sources(spark), given="given").collect()] == ["thai_news", "general", "given"]


def test_stream_equals_batch(spark, tmp_path, sample_text):
    rows = [(i, f"{sample_text} {i % 3}", "en") for i in range(6)] + [(9, "bad", "en")]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = ingest.stream_documents(spark, f"file://{tmp_path}/in/*", "doc_id long, text string, lang string")
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    ingest.ingest(stream, out, mark, min_words=20).awaitTermination()
    ingest.ingest(stream, out, mark, min_words=20).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 3 and got.select("content_hash").distinct().count() == 3
    assert ingest.first_texts(spark.read.parquet(f"file://{tmp_path}/in/*")).select(F.count("*").alias("n")).first().n == 4


def test_articles_and_robots(spark):
    from textlake.operators import robots
    from textlake.sources import article

    long = "word " * 40
    rows = [("https://www.bbc.com/x", f'<body><article>no</article><div class="article__body-content"><p>{long}<nav>n</nav></div><span class="byline__name"> Ann </span>'), ("https://e.org", f"<body><article>tiny</article><p>{long}</body>"), ("https://e.org/2", None)]
    out = article.articles(spark.createDataFrame(rows, "url string, html string")).collect()
    assert out[0].content == long.strip() and out[0].author == "Ann"
    assert out[1].content == "tiny " + long.strip() and out[2].content == ""
    assert article.articles(spark.createDataFrame(rows, "url string, html string"), legacy=True).first().content.startswith("no ")
    files = spark.createDataFrame([("e.org", 200, "User-agent: *\nDisallow: /a\nAllow: /a/b"), ("f.org", 500, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    pages = spark.createDataFrame([(1, "https://e.org/a/x"), (2, "https://e.org/a/b"), (3, "https://f.org/"), (4, "https://e.org")], "page_id int, url string")
    assert {r.page_id: r.allowed for r in robots.allowed(pages, robots.parse_rules(files)).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_patterns_are_sought_once_and_only_where_a_page_can_hold_them(spark):
    rows = [
        (0, None), (1, ""), (2, "<p>no such thing</p>"), (3, '<META Property="Article:Published_Time" x=1 CONTENT="2024-05-06">'), (4, '<meta content="a > b" name="keywords"><a REL="TAG" href=x> c </a>'),
        (5, '<TIME datetime="2024-05-07 01:02:03">'), (6, '<script TYPE="Application/LD+JSON">{"datePublished": "2024-05-08", "keywords": ["z", "y"], "author": "A"}</script>'), (7, '<meta name="date" content="soon"><meta name="date" content="2024-05-09">'),
    ]
    df = spark.createDataFrame(rows, "id int, html string")
    html = F.col("html")
    found = df.select("id", F.date_format(U.published_at(html), "yyyy-MM-dd").alias("d"), U.tags(html).alias("t"), U.author(html).alias("a")).orderBy("id").collect()
    assert [r.d for r in found] == [None, None, None, "2024-05-06", None, "2024-05-07", "2024-05-08", None]
    assert [r.t for r in found] == [None, [], [], [], ["a > b", "c"], [], ["y", "z"], []] and [r.a for r in found] == [None] * 6 + ["A", None]
    plan = df.select(U.published_at(html))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('"pubdate"[^>]*content=') <= 4  # not once a form of dates
