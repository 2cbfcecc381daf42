"""Fetching pages by a plug-in: retries with growing waits, politeness by domain, and what counts as a page.

URLs are dealt out by domain, so a domain's requests come from one task, one after the other with a pause between them: that is
the limit that politeness sets, whatever the cluster's size. Nothing is fetched twice in a call; a failing URL is an outcome, not an error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

RETRIES, FIRST_WAIT, BACKOFF, PAUSE = 3, 1.0, 2.0, 1.0
OUTCOMES = ("ok", "not_html", "http_error", "network_error", "blocked")


class Response(NamedTuple):
    status: int
    content_type: str
    body: str
    url: str | None = None  # where redirects led


class Fetcher(Protocol):
    """get() raises OSError (or what derives from it) for network errors, which are tried again."""

    def get(self, url: str) -> Response: ...


def attempt(fetcher: Fetcher, url: str, retries: int = RETRIES, wait: float = FIRST_WAIT, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> tuple[str, Response | None, int]:
    """(outcome, response, tries): network errors are retried, other failures are final."""
    for n in range(retries + 1):
        if n:
            sleep(wait * backoff ** (n - 1))
        try:
            got = fetcher.get(url)
        except OSError:
            continue
        if "text/html" not in (got.content_type or "").lower():
            return "not_html", got, n + 1
        return ("http_error" if got.status >= 400 else "ok"), got, n + 1
    return "network_error", None, retries + 1


def fetch(urls: DataFrame, fetcher: Fetcher, retries: int = RETRIES, wait: float = FIRST_WAIT, backoff: float = BACKOFF, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """(url, final_url, status, outcome, tries, html) of every distinct url; html of pages only. `allowed`, if a column, false -> blocked."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for part in parts:
            rows = []
            for url, domain, allowed in zip(part.url, part.domain, part.allowed, strict=True):
                if not allowed:
                    rows.append((url, None, None, "blocked", 0, None))
                    continue
                rest = pause - (clock() - last[domain]) if domain in last else 0.0
                if rest > 0:
                    sleep(rest)
                last = {domain: clock()}  # rows are sorted by domain
                outcome, got, tries = attempt(fetcher, url, retries, wait, backoff, sleep)
                rows.append((url, got and (got.url or url), got and got.status, outcome, tries, got.body if outcome == "ok" else None))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "outcome", "tries", "html"]).astype({"status": "Int32"})

    rows = urls.select("url", F.lower(U.authority(F.col("url"))).alias("domain"), F.coalesce(F.col("allowed"), F.lit(True)).alias("allowed") if "allowed" in urls.columns else F.lit(True).alias("allowed")).where("url is not null")
    rows = rows.groupBy("url", "domain").agg(F.bool_and("allowed").alias("allowed"))
    return rows.repartition("domain").sortWithinPartitions("domain", "url").mapInPandas(run, "url string, final_url string, status int, outcome string, tries int, html string")


def pages(urls: DataFrame, fetcher: Fetcher, **kw) -> DataFrame:
    """(url, html) of the pages that were fetched, for crawl()."""
    return fetch(urls, fetcher, **kw).where("outcome = 'ok'").select("url", "html")
