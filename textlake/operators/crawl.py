"""Breadth-first crawls and sitemaps; fetching is a join with a table of pages, or a plug-in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..plans.scratch import materialise


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """(node, depth) of every node within max_depth links (src, dst) of the seeds (node): one anti-join with the visited for each level."""
    visited = materialise(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "front")
    front = visited
    for depth in range(1, max_depth + 1):
        front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(visited.select("node"), "node", "left_anti")
        front = materialise(front.withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited


def crawl(pages: DataFrame | None, seeds: list[str], max_depth: int = 2, max_pages: int = 50, follow_external: bool = False, fetch: Callable[[DataFrame], DataFrame] | None = None, sitemap: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
    """(url, depth, content_hash, html): pages reached, first of equal contents only, and those alone are expanded.

    pages (url, html) stands for the network; else fetch turns (url) rows into (url, html), see fetch.pages(). sitemap (url) adds seeds of the
    seeds' sites. Order within a level is by url; max_pages is the feature's own limit.
    """
    spark = spark or pages.sparkSession
    if fetch is None:
        site = materialise(pages.select(U.normalize_url(F.col("url")).alias("url"), "html").dropDuplicates(["url"]), "site")
        fetch = lambda urls: urls.join(site, "url")
    own = lambda df: df.select(U.normalize_url(F.col("url")).alias("url"), F.lower(U.authority(F.col("url"))).alias("site")).distinct()
    front = own(spark.createDataFrame([(s,) for s in seeds], "url string"))
    if sitemap is not None:
        more = own(sitemap.select("url").where(U.is_valid_url(F.col("url"))))
        front = front.unionByName(more if follow_external else more.join(front.select("site").distinct(), "site", "left_semi").select("url", "site")).distinct()
    front = materialise(front, "front")
    seen = front.select("url")
    got = None
    for depth in range(max_depth + 1):
        fetched = materialise(fetch(front.select("url")).select("url", "html").join(front, "url").select("url", F.lit(depth).alias("depth"), F.sha2("html", 256).alias("content_hash"), "html", "site"), "fetched")
        first = fetched.groupBy("content_hash").agg(F.min("url").alias("url"))
        fetched = fetched.join(first, ["content_hash", "url"], "left_semi")
        if got is not None:
            fetched = fetched.join(got.select("content_hash"), "content_hash", "left_anti")
        fetched = materialise(fetched.select("url", "depth", "content_hash", "html", "site"), "level")
        got = fetched if got is None else got.unionByName(fetched)
        if depth == max_depth or got.count() >= max_pages:
            break
        found = fetched.select("url", "site", F.explode(U.links(F.col("html"))).alias("link")).select("site", U.normalize_url(U.absolute(F.col("url"), F.col("link"))).alias("url"))
        if not follow_external:
            found = found.where(F.lower(U.authority(F.col("url"))) == F.col("site"))
        front = materialise(found.where(U.is_valid_url(F.col("url"))).groupBy("url").agg(F.min("site").alias("site")).join(seen, "url", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("url"))
    return got.orderBy("depth", "url").limit(max_pages).drop("site")


def crawl_legacy(pages: DataFrame, start: str, max_depth: int = 2, max_pages: int = 50, follow_external: bool = False) -> DataFrame:
    """(url, depth, title, content): the older crawl, which keeps pages of equal content and takes links as they are but for closing slashes."""
    spark = pages.sparkSession
    site = pages.select(F.rtrim(F.col("url"), F.lit("/")).alias("url"), "html").dropDuplicates(["url"])
    links = site.select("url", F.explode(U.links(F.col("html"))).alias("link")).select(F.col("url").alias("src"), F.rtrim(U.absolute(F.col("url"), F.col("link")), F.lit("/")).alias("dst"))
    links = links.where(U.is_valid_url(F.col("dst")) & ~F.col("dst").contains("#"))
    if not follow_external:
        links = links.where(F.lower(U.authority(F.col("dst"))) == F.lower(U.authority(F.lit(start))))
    first = spark.createDataFrame([(start.rstrip("/"),)], "node string")
    reached = bfs(links.where("src <> dst"), first, max_depth).withColumnRenamed("node", "url")
    title = F.coalesce(F.nullif(U.title(F.col("html")), F.lit("")), F.col("url"))
    return reached.join(site, "url").orderBy("depth", "url").limit(max_pages).select("url", "depth", title.alias("title"), U.rough_text(F.col("html")).alias("content"))


def discover_sitemaps(resources: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """Distinct page urls of the sitemaps (url) and of those their indexes name, max_depth levels down; resources (url, xml) stands for the network."""
    seen = front = materialise(roots.select("url").distinct(), "sitemaps")
    found = None
    for _ in range(max_depth + 1):
        got = front.join(resources.select("url", "xml"), "url").select("xml", F.expr("transform(xpath(xml, '//*[local-name()=\"loc\"]/text()'), x -> trim(x))").alias("locs"))
        got = materialise(got.select(F.expr("xml rlike '<([A-Za-z0-9]+:)?sitemap[ >]'").alias("is_index"), "locs"), "locs")
        urls = got.where("not is_index").select(F.explode("locs").alias("url")).where("url <> ''")
        found = urls if found is None else found.unionByName(urls)
        front = materialise(got.where("is_index").select(F.explode("locs").alias("url")).where("url <> ''").distinct().join(seen, "url", "left_anti"), "sitemaps")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return found.distinct()
