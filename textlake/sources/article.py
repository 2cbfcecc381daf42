"""Articles from pages: containers by site selectors, noise removed, fields in their order of trust."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# fixed values: selectors and noise tags by site
CONTENT = ("article", "main", '[role="main"]', ".post-content", ".article-body", ".entry-content", ".content-body", ".story-content", "#content", "#main")
CONTENT_LEGACY = ("article", '[role="main"]', "main", ".post-content", ".article-body", ".entry-content", ".content-body", "#content", "#main")
AUTHOR = (".author", ".byline", '[rel="author"]', ".post-author", ".entry-author")
NOISE = ("script", "style", "nav", "footer", "header", "aside", "noscript", "figure", "form")
SITES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "bbc.com": ((".article__body-content", '[data-component="text-block"]', ".story-body__inner", "article"), (".byline__name", ".author-name", ".contributor-name"), NOISE),
    "bbc.co.uk": ((".article__body-content", '[data-component="text-block"]', ".story-body__inner", "article"), (".byline__name", ".author-name", ".contributor-name"), NOISE),
    "cnn.com": ((".article__content", ".zn-body__paragraph", ".l-container", "article"), (".byline__name", ".metadata__byline__author", ".author__name"), NOISE),
    "medium.com": (('section[data-field="body"]', ".story-body", "article"), (".pw-author-name", ".author-name", 'a[rel="author"]'), (*NOISE, "svg")),
}
DEFAULT = (CONTENT, AUTHOR, NOISE)
DATES = {
    "bbc.com": ("article:published_time", "datePublished"),
    "bbc.co.uk": ("article:published_time", "datePublished"),
    "cnn.com": ("og:article:published_time", "article:published_time", "pubdate", "date"),
    "medium.com": ("article:published_time", "parsely-pub-date"),
}
OVERLAYS = {"medium.com": ("meteredContent", "overlay", "branch-journey-wrapper")}
#: A container with less text gives way to the body.
MIN_CONTENT = 100
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SELECTOR = re.compile(r"""([a-z][a-z0-9]*)?(?:\.([\w-]+)|\#([\w-]+)|\[([\w-]+)=["']?([^"'\]]*)["']?\])?""")


class _Element:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self) -> Iterator[_Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += [k for k in reversed(e.kids) if isinstance(k, _Element)]

    def select(self, selector: str) -> _Element | None:
        """First element in page order that a simple selector (tag, .class, #id, [attribute=value]) matches."""
        tag, cls, ident, name, value = _SELECTOR.fullmatch(selector).groups()
        for e in self.walk():
            a = e.attrs
            if (not tag or e.tag == tag) and (not cls or cls in a.get("class", "").split()) and (not ident or a.get("id") == ident) and (not name or a.get(name) == value):
                return e
        return None

    def text(self, noise: frozenset[str]) -> str:
        parts, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                parts.append(e)
            elif e is self or e.tag not in noise:
                todo += reversed(e.kids)
        return " ".join(" ".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("#root", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.stack[-1].tag == "p":
            self.stack.pop()
        e = _Element(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].kids.append(e)
        if tag not in _VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].kids.append(_Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].kids.append(data)


def adapter(host: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """Selectors of a site: its host as it is, without www., else the defaults."""
    host = (host or "").lower()
    return SITES.get(host) or SITES.get(host.removeprefix("www.")) or DEFAULT


def _remove(root: _Element, classes: frozenset[str]) -> None:
    """Take out the elements that have one of the classes."""
    for e in root.walk():
        e.kids = [k for k in e.kids if isinstance(k, str) or classes.isdisjoint(k.attrs.get("class", "").split())]


def published(html: Column, url: Column) -> Column:
    """The date by the site's own meta elements, where it has such; else by the general ones."""
    host = F.regexp_replace(F.lower(U.authority(url)), r"^www\.", "")
    out = U.published_at(html)
    for site, names in DATES.items():
        out = F.when(host == site, U.published_at(html, names)).otherwise(out)
    return out


def scrape(host: str, html: str, legacy: bool = False) -> tuple[str, str | None]:
    """(content, author by selector) of a page."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    root = builder.root
    bare = (host or "").lower().removeprefix("www.")
    if bare in OVERLAYS:
        _remove(root, frozenset(OVERLAYS[bare]))
    contents, authors, noise = (CONTENT_LEGACY, AUTHOR, NOISE) if legacy else adapter(host)
    noise = frozenset(noise)
    found = next((e for e in map(root.select, contents) if e is not None), None)
    content = found.text(noise) if found is not None else ""
    if len(content) < MIN_CONTENT:
        body = root.select("body") or root
        content = max(content, body.text(noise), key=len)
    by = next((t for e in map(root.select, authors) if e is not None and (t := e.text(frozenset()))), None)
    return content, by


def articles(pages: DataFrame, legacy: bool = False) -> DataFrame:
    """(url, title, content, author, description, published_at, tags, images, canonical_url, language) of (url, html) rows; other columns stay."""

    @F.pandas_udf("content string, by string")
    def run(host: pd.Series, html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scrape(h, p, legacy) for h, p in zip(host, html, strict=True)], columns=["content", "by"])

    page = F.col("html")
    images = U.images(page, F.col("url"))
    if legacy:
        images = F.slice(F.filter(images, lambda x: x.startswith("http")), 1, 10)
    return (
        pages.withColumn("_a", run(U.authority(F.col("url")), "html"))
        .withColumn("title", F.coalesce(U.meta(page, "og:title"), U.title(page)))
        .withColumn("content", F.col("_a.content"))
        .withColumn("author", F.coalesce(U.author(page), F.col("_a.by")))
        .withColumn("description", F.coalesce(U.meta(page, "description"), U.meta(page, "og:description")))
        .withColumn("published_at", published(page, F.col("url")))
        .withColumn("tags", U.tags(page))
        .withColumn("images", images)
        .withColumn("canonical_url", U.canonical(page))
        .withColumn("language", U.html_lang(page))
        .drop("_a")
    )
