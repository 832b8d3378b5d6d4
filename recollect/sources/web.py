"""Fetching pages. URLs arrive as a DataFrame, so Spark spreads the requests."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.html import html_main_content
from recollect.functions.web import html_title, numbered_name, page_document, url_filename
from recollect.operators.common import number_in_group

MAX_PAGE_BYTES = 5 * 1024 * 1024
ENCODINGS = ("utf-8", "cp1251", "latin-1")


class PageError(Exception):
    """Why there is no page."""


def http_get(url: str, timeout: float = 30.0) -> str:
    """Page text; raises PageError when unreachable, larger than the limit or not text."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as response:  # noqa: S310
            data = response.read(MAX_PAGE_BYTES + 1)
    except (OSError, ValueError) as e:
        raise PageError(f"unreachable: {e}") from e
    if len(data) > MAX_PAGE_BYTES:
        raise PageError(f"larger than {MAX_PAGE_BYTES} bytes")
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise PageError("not text")


def fetch_pages(urls: DataFrame, url: str = "url", get: Callable[[str], str | None] = http_get) -> DataFrame:
    """(url, html, status, reason) of every URL: ``fetched``, ``empty`` or ``failed`` with its reason."""

    def one(address: str | None) -> tuple[str | None, str, str | None]:
        try:
            page = get(address)
        except PageError as e:
            return None, "failed", str(e)
        if page is None:
            return None, "failed", "unreachable"
        return (page, "fetched", None) if page else (None, "empty", None)

    def run(batches):
        for batch in batches:
            pages = pd.DataFrame([one(u) for u in batch["url"]], columns=["html", "status", "reason"])
            pages.insert(0, "url", batch["url"])
            yield pages

    return urls.select(F.col(url).alias("url")).mapInPandas(run, "url string, html string, status string, reason string")


def page_report(pages: DataFrame) -> DataFrame:
    """Title, readable content and sizes of pages (url, html, ...)."""
    return (
        pages.withColumn("title", html_title(F.col("html")))
        .withColumn("content", html_main_content(F.col("html")))
        .withColumn("html_length", F.length("html"))
        .withColumn("content_length", F.length("content"))
    )


def saved_pages(report: DataFrame, order: str, saved_at, project=None, block_rows: int = 1_000_000) -> DataFrame:
    """File name and document text per page; clashing names are numbered in ``order``."""
    named = report.withColumn("_name", url_filename(F.col("url")))
    # Only later bearers of a name take part in the join; the documents mostly stay where they are.
    clashes = number_in_group(
        named.select(order, "_name"), ["_name"], order, F.floor(F.col(order) / block_rows), "_n"
    ).where(F.col("_n") > 0).select(order, "_n")
    text = page_document(F.col("url"), F.col("title"), saved_at, F.lit(None) if project is None else project, F.col("content"))
    return (
        named.withColumn("document", text).join(clashes, order, "left")
        .withColumn("file", numbered_name(F.col("_name"), F.coalesce("_n", F.lit(0)))).drop("_name", "_n")
    )
