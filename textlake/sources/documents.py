"""Sources of documents: every one gives id, source, source_type, url, title, text, language, metadata, created_at."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from . import archives

SOURCE_TYPES = ("web", "pdf", "database", "huggingface", "common_crawl", "upload", "api")
SCHEMA = "id string, source string, source_type string, url string, title string, text string, language string, metadata map<string,string>, created_at timestamp"
#: Tags whose text is no page text.
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "aside"))
#: Pages that a parser holds as Python objects at a time.
PAGES = 64


def as_documents(df: DataFrame, source: str, kind: str, text: Column, title: Column, url: Column | None = None, language: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Project rows onto the document columns; rows of blank text are dropped."""
    if kind not in SOURCE_TYPES:
        raise ValueError(f"unknown source type {kind!r}")
    url = url if url is not None else F.lit(None).cast("string")
    rows = df.select(
        F.lit(source).alias("source"),
        F.lit(kind).alias("source_type"),
        url.alias("url"),
        title.alias("title"),
        text.alias("text"),
        F.coalesce(language, F.lit("en")).alias("language") if language is not None else F.lit("en").alias("language"),
        (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata"),
        F.current_timestamp().alias("created_at"),
    )
    return rows.where(T.strip(F.col("text")) != "").select(F.sha2(F.concat_ws("\x00", "source", "url", "text"), 256).alias("id"), *rows.columns)


def scalar_metadata(df: DataFrame, without: set[str]) -> Column:
    """The other columns of scalar types as a map."""
    kinds = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    pairs = [x for n, t in df.dtypes if n not in without and t in kinds for x in (F.lit(n), F.col(n).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def from_dataset(df: DataFrame, name: str, text: str = "text", title: str | None = None, url: str | None = None, language: str = "en", max_samples: int | None = None) -> DataFrame:
    """A hub dataset: the title falls back to the text's first 80 characters; the other columns become metadata."""
    df = df.where(T.strip(F.col(text).cast("string")) != "")
    df = df.limit(max_samples) if max_samples else df
    start = F.translate(F.substring(F.col(text), 1, 80), "\n", " ")
    name_of = F.coalesce(F.nullif(F.col(title), F.lit("")), start) if title else start
    return as_documents(df, name, "huggingface", F.col(text), name_of, F.col(url) if url else None, F.lit(language), scalar_metadata(df, {text, title, url}))


def from_database(df: DataFrame, name: str, title: str = "Untitled") -> DataFrame:
    """Rows of a query (spark.read.jdbc or any table): text from content, body or text."""
    texts = [F.col(c) for c in ("content", "body", "text") if c in df.columns]
    head = F.coalesce(F.col("title"), F.lit(title)) if "title" in df.columns else F.lit(title)
    return as_documents(df, name, "database", F.coalesce(*texts, F.lit("")), head, F.col("url") if "url" in df.columns else None, None, scalar_metadata(df, {"content", "body", "text", "title", "url"}))


def from_text(spark: SparkSession, texts: list[tuple[str, str]], source: str = "api") -> DataFrame:
    """(title, text) pairs handed in by a caller."""
    df = spark.createDataFrame(texts, "title string, text string")
    return as_documents(df, source, "api", F.col("text"), F.col("title"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded text files, one document each; bytes that are no UTF-8 are replaced."""
    df = spark.read.format("binaryFile").load(path)
    return as_documents(df, "upload", "upload", F.make_valid_utf8(F.col("content").cast("string")), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), F.col("path"))


def from_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """PDF files by a pluggable extractor; files that it fails on are skipped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for at, data in zip(part.path, part.content, strict=True):
                try:
                    rows.append((at, extract(data)))
                except Exception:  # noqa: BLE001  an unreadable file is not the batch's end
                    continue
            yield pd.DataFrame(rows, columns=["path", "text"])

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
    return as_documents(df, "pdf", "pdf", F.col("text"), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), F.col("path"))


class _Text(HTMLParser):
    """Text outside dropped tags, and the title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.in_title, self.title, self.parts = 0, False, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in DROPPED
        self.in_title |= tag == "title"

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in DROPPED))
        self.in_title &= tag != "title"

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)
            if self.in_title:
                self.title.append(data)


def page_text(html: str) -> tuple[str, str]:
    """(title, text with single spaces)."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return " ".join("".join(parser.title).split()), " ".join(" ".join(parser.parts).split())


def parse_pages(pages: DataFrame) -> DataFrame:
    """Adds title and text to (url, html) rows, by a tolerant parser; of an Arrow batch, PAGES pages are Python objects at a time."""
    kind = pa.struct([("title", pa.string()), ("text", pa.string())])

    @F.arrow_udf("title string, text string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            for i in range(0, len(html), PAGES):
                yield pa.array([dict(zip(("title", "text"), page_text(h.as_py()), strict=True)) for h in html.slice(i, PAGES)], kind)

    return pages.withColumn("_p", run("html")).withColumn("title", F.col("_p.title")).withColumn("text", F.col("_p.text")).drop("_p")


def from_website(crawled: DataFrame) -> DataFrame:
    """Crawled pages (url, depth, content_hash, html) as documents."""
    df = parse_pages(crawled)
    page = F.col("html")
    held = {"depth": F.col("depth").cast("string"), "content_hash": F.col("content_hash"), "crawled_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "description": U.meta(page, "description"), "canonical_url": U.canonical(page)}
    meta = F.map_filter(F.create_map(*(x for k, v in held.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return as_documents(df, "website", "web", F.col("text"), F.col("title"), F.col("url"), U.html_lang(F.col("html")), meta)


def from_common_crawl(spark: SparkSession, path: str, max_docs_per_file: int | None = None, min_chars: int = 100, **options) -> DataFrame:
    """HTML responses with more than min_chars of text; the cap counts documents of a file. Archives are read in ranges, see archives."""
    archives.register(spark)
    found = spark.read.format("textlake_warc").options(path=path, kind="response", html="true", **options).load().where("http is not null")

    @F.pandas_udf("title string, text string")
    def texts(http: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_text(bytes(h).partition(b"\r\n\r\n")[2].decode("utf-8", "replace")) for h in http], columns=["title", "text"])

    df = found.select("path", "member", "pos", "url", texts("http").alias("p")).select("path", "member", "pos", "url", F.coalesce(F.nullif("p.title", F.lit("")), "url").alias("title"), "p.text").where(F.length("text") > min_chars)
    if max_docs_per_file:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("member", "pos"))).where(F.col("_n") <= max_docs_per_file)
    meta = F.create_map(F.lit("file"), F.col("path"), F.lit("member"), F.col("member").cast("string"))
    return as_documents(df, "common_crawl", "common_crawl", F.col("text"), F.col("title"), F.col("url"), metadata=meta)


def sitemap_urls(xml: DataFrame) -> DataFrame:
    """Every loc of sitemaps (xml string column)."""
    return xml.select(F.explode(F.expr("xpath(xml, '//*[local-name()=\"loc\"]/text()')")).alias("url")).select(F.trim("url").alias("url"))


_PART = "array<struct<_VALUE:string,_href:string,_rel:string,name:string>>"
_ITEM = "struct<" + ",".join(f"{n}:{_PART}" for n in ("title", "link", "guid", "id", "pubDate", "published", "updated", "description", "summary", "content", "creator", "author")) + ">"
#: RSS with and without a channel, RDF, and Atom, whatever their prefixes.
FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>"


def feed_items(feeds: DataFrame) -> DataFrame:
    """Entries of RSS or Atom feeds (feed_url, xml), newest first, those without a date last; those without link or id are left out, and so are feeds that don't parse."""
    parsed = F.from_xml("xml", FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    none = F.array().cast(f"array<{_ITEM}>")
    rows = feeds.select("feed_url", parsed.alias("p")).select("feed_url", F.explode(F.concat(*(F.coalesce(c, none) for c in ("p.channel.item", "p.item", "p.entry")))).alias("i"))

    def values(name: str, field: str = "_VALUE") -> Column:
        return F.filter(F.transform(f"i.{name}", lambda x: F.nullif(F.trim(x[field]), F.lit(""))), lambda x: x.isNotNull())

    first = lambda *c: F.coalesce(*(F.get(x, 0) for x in c))
    page = F.filter("i.link", lambda x: x["_href"].isNotNull() & F.coalesce(x["_rel"] == "alternate", F.lit(True)))
    date = first(values("pubDate"), values("published"), values("updated"))
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd")
    return rows.select(
        "feed_url",
        first(values("title")).alias("title"),
        first(F.transform(page, lambda x: x["_href"]), values("link", "_href"), values("link"), values("guid"), values("id")).alias("url"),
        T.one_line(T.strip_tags(F.coalesce(first(values("description"), values("summary"), values("content")), F.lit("")))).alias("summary"),
        first(values("creator"), values("author", "name"), values("author")).alias("author"),
        F.coalesce(U.rfc_date(date), *(F.try_to_timestamp(date, F.lit(f)) for f in forms)).alias("published_at"),
    ).where("url is not null").orderBy(F.desc_nulls_last("published_at"), "url")


def stored_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text objects below a path with their keys."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("text"))


class DocumentSource(DataSource):
    """spark.read.format("textlake_documents"): a base for sources in Python; load() gives (title, text) pairs for each part."""

    @classmethod
    def name(cls) -> str:
        return "textlake_documents"

    def schema(self) -> str:
        return "title string, text string"

    def load(self, part: int, parts: int) -> Iterator[tuple[str, str]]:
        for k in range(part, int(self.options.get("rows", "0")), parts):
            yield f"title {k}", f"text {k}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self, int(self.options.get("parts", "2")))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self, int(self.options.get("parts", "2")))


class _Reader(DataSourceReader):
    def __init__(self, source: DocumentSource, parts: int):
        self.source, self.parts = source, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        yield from self.source.load(partition.value, self.parts)


class _StreamReader(SimpleDataSourceStreamReader):
    """The parts of a source one after the other, a part for each trigger."""

    def __init__(self, source: DocumentSource, parts: int):
        self.source, self.parts = source, parts

    def initialOffset(self) -> dict:
        return {"part": 0}

    def read(self, start: dict):
        part = start["part"]
        if part >= self.parts:
            return iter(()), start
        return iter(list(self.source.load(part, self.parts))), {"part": part + 1}  # a part is kept until it is committed

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([row for part in range(start["part"], end["part"]) for row in self.source.load(part, self.parts)])

    def commit(self, end: dict) -> None:
        pass
