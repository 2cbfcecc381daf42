"""Column functions over URLs and simple page markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def authority(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain(c: Column) -> Column:
    """Host and port without a leading www., case kept; 'unknown' without one."""
    bare = F.regexp_replace(authority(c), r"^www\.", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit("unknown")).otherwise(bare)


def is_valid_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def is_same_domain(a: Column, b: Column) -> Column:
    return F.lower(authority(a)) == F.lower(authority(b))


def normalize_url(c: Column) -> Column:
    """Lower scheme and host, sorted query, no fragment, no trailing slash but for the root; for queries without escapes."""
    head = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+$", ""))
    query = F.regexp_extract(F.trim(c), r"^[^?#]*\?([^#]*)", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.when(head == "", c).otherwise(F.concat(head, path, F.when(ordered == "", F.lit("")).otherwise(F.concat(F.lit("?"), ordered))))


def normalize_url_exact(c: Column) -> Column:
    """The same with escapes in queries decoded and encoded again: names in order, values of a name in theirs, blank ones kept."""
    url = F.trim(c)
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    whole = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    params = F.regexp_extract(whole, r"(;[^/]*)$", 1)
    path = F.regexp_replace(whole, r";[^/]*$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+$", ""))
    plain = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    escaped = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    pairs = F.transform(parts, lambda x, i: F.struct(plain(F.substring_index(x, "=", 1)).alias("name"), i.alias("at"), plain(F.regexp_replace(x, "^[^=]*=?", "")).alias("value")))
    query = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(escaped(p["name"]), F.lit("="), escaped(p["value"]))), "&")
    return F.when(head == "", c).otherwise(F.concat(head, path, F.when(params == ";", "").otherwise(params), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def links(html: Column) -> Column:
    """Targets in page order, once each, without anchors, mail, phone and script links."""
    found = F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(r"^(#|mailto:|tel:|javascript:)") & (x != "")))


def absolute(base: Column, link: Column) -> Column:
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(root, F.lit("/"), link))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_lang(html: Column) -> Column:
    found = F.regexp_extract(html, r'<html[^>]*lang="([^"]*)"', 1)
    return F.when(found == "", F.lit("en")).otherwise(found)


def rough_text(html: Column) -> Column:
    """Text without the tags that hold no content, by patterns."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|aside|noscript)\b[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]+>", " "), r"\s+", " "))


def images(html: Column, page: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r'<img[^>]*\bsrc="([^"]+)"'), 1)
    return F.array_distinct(F.transform(found, lambda x: absolute(page, x)))


def _holds(html: Column, part: str) -> Column:
    """Whether a page holds a piece of text, in either case: a quick test before a pattern that can't match without it."""
    return F.contains(F.lower(html), F.lit(part.lower()))


def meta(html: Column, name: str) -> Column:
    """content of the meta element with that name or property, null if none."""
    a = F.regexp_extract(html, rf'(?is)<meta[^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1)
    b = F.regexp_extract(html, rf'(?is)<meta[^>]*content="([^"]*)"[^>]*(?:name|property)="{name}"', 1)
    return F.when(_holds(html, f'="{name}"'), F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def canonical(html: Column) -> Column:
    link = F.regexp_extract(html, r'(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)
    return F.coalesce(F.nullif(link, F.lit("")), meta(html, "og:url"))


def json_objects(html: Column) -> Column:
    """The JSON-LD objects of a page as variants: lists and @graph taken apart, bad JSON and bare values left out."""
    bodies = F.when(_holds(html, "application/ld+json"), F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)).when(html.isNotNull(), F.array().cast("array<string>"))
    none = F.array().cast("array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    listed = lambda v: F.when(kind(v).startswith("ARRAY"), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)).otherwise(F.array(v))
    flat = F.flatten(F.transform(F.filter(F.transform(bodies, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull()), listed))
    graphs = F.flatten(F.transform(flat, lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))))
    return F.filter(graphs, lambda v: kind(v).startswith("OBJECT"))


def json_ld(html: Column) -> Column:
    """The same as JSON strings."""
    return F.transform(json_objects(html), lambda v: F.to_json(v))


def _first(html: Column, found) -> Column:
    """What the first object has for which found(variant) is not null."""
    return F.get(F.filter(F.transform(json_objects(html), found), lambda x: x.isNotNull()), 0)


def _text(v: Column, path: str) -> Column:
    """The string at a path; null for objects, lists and numbers."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def author(html: Column) -> Column:
    """From JSON-LD (name of the first author: an object, a list of objects or names, or a name), else the author meta element."""
    name = lambda v: F.coalesce(*(_text(v, p) for p in ("$.author.name", "$.author[0].name", "$.author[0]", "$.author")))
    return F.coalesce(_first(html, name), F.trim(meta(html, "author")))


def rfc_date(c: Column) -> Column:
    """Timestamp of `Mon, 06 May 2024 07:08:09 GMT` and the like, null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))


DATE_NAMES = ("article:published_time", "og:article:published_time", "datePublished", "pubdate", "publishdate", "date")


def published_at(html: Column, names: tuple[str, ...] = DATE_NAMES) -> Column:
    """From JSON-LD, meta elements of those names, then time elements; the first that can be parsed."""
    raw = [_first(html, lambda v: _text(v, "$.datePublished"))]
    raw += [meta(html, n) for n in names]
    raw.append(F.when(_holds(html, "<time"), F.nullif(F.regexp_extract(html, r'(?is)<time[^>]*datetime="([^"]*)"', 1), F.lit(""))))
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    parsed = lambda r: F.coalesce(*(F.try_to_timestamp(r, F.lit(f)) for f in forms), rfc_date(r))
    return F.coalesce(*(T.let(r, parsed) for r in raw))  # each is looked for once, not once a form


def tags(html: Column) -> Column:
    """Sorted distinct keywords of meta elements, rel=tag links and JSON-LD."""
    empty = F.array().cast("array<string>")
    split = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    of_meta = F.coalesce(split(meta(html, "keywords")), empty)
    links = F.when(_holds(html, 'rel="tag"'), F.regexp_extract_all(html, F.lit(r'(?is)<a[^>]*rel="tag"[^>]*>(.*?)</a>'), 1)).when(html.isNotNull(), empty)
    of_links = F.transform(links, lambda x: F.trim(x))
    of_json = F.flatten(F.transform(json_objects(html), lambda v: F.coalesce(F.try_variant_get(v, "$.keywords", "array<string>"), split(_text(v, "$.keywords")), empty)))
    return F.array_sort(F.array_distinct(F.concat(of_meta, of_links, of_json)))
