"""Status and link enrichment over recorded responses."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.urls import is_http
from weir.operators.attribution import keep_status
from weir.operators.filters import shown_status, status_filter

#: Larger bodies are cut to so many bytes before they are parsed.
BODY_BYTES = 10 << 20


def check_status(urls: DataFrame, probes: DataFrame, include=(), exclude=()) -> DataFrame:
    """``url, status`` of a look-up of ``probes(url, http_status)``; a URL without an answer counts as failed."""
    known = probes.groupBy("url").agg(F.max("http_status").alias("http_status"))
    joined = urls.select("url").distinct().join(known, "url", "left")
    return joined.where(status_filter(F.col("http_status"), include, exclude)).select("url", shown_status(F.col("http_status")).alias("status"))


def is_fetchable(href: Column) -> Column:
    """Not blank, not a fragment, no scheme that names no page; a colon after a slash makes no scheme."""
    h = F.trim(href)
    return (h != "") & ~F.startswith(h, F.lit("#")) & ~F.rlike(F.lower(h), F.lit(r"^(javascript|mailto|tel|data|about|blob):"))


def is_html_like(content_type: Column) -> Column:
    low = F.lower(content_type)
    return content_type.isNull() | F.contains(low, F.lit("html")) | F.contains(low, F.lit("xml")) | F.contains(low, F.lit("text/plain"))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = dict(reversed(attrs)).get("href")
        if href is None:
            return
        if tag == "base" and self.base is None:
            self.base = href
        elif tag == "a":
            self.found.append(href)


_IGNORED = ("javascript:", "mailto:", "tel:", "data:", "about:", "blob:")


def links_of(url: str, html: str | None) -> list[str]:
    """Absolute targets of ``a[href]``, in order, repeated ones too; the first ``base`` counts."""
    parser = _Links()
    parser.feed(html or "")
    try:
        base = urljoin(url, parser.base.strip()) if parser.base else url
    except ValueError:
        base = url
    out = []
    for href in parser.found:
        href = href.strip()
        if not href or href.startswith("#") or href.lower().startswith(_IGNORED):
            continue
        try:
            out.append(urljoin(base, href))
        except ValueError:
            continue
    return out


def _cut(html: Column) -> Column:
    short = F.make_valid_utf8(F.decode(F.substring(F.encode(html, "UTF-8"), 1, BODY_BYTES), "UTF-8"))
    return F.when(F.octet_length(html) <= BODY_BYTES, html).otherwise(short)


def extract_links(pages: DataFrame, *, native: bool = False) -> DataFrame:
    """``url, link`` of ``url, html`` and, where there are such columns, ``http_status, content_type``.

    Pages that aren't 2xx or don't look like HTML give nothing. ``native`` takes double-quoted, root-relative or
    absolute links without character references, by regular expressions.
    """
    rows = pages
    if "http_status" in pages.columns:
        rows = rows.where(F.col("http_status").between(200, 299))
    if "content_type" in pages.columns:
        rows = rows.where(is_html_like(F.col("content_type")))
    if native:
        href = F.explode(F.regexp_extract_all(_cut(F.col("html")), F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1)))
        hrefs = rows.select("url", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin"), href.alias("href")).where(is_fetchable(F.col("href")))
        link = F.when(F.startswith("href", F.lit("/")), F.concat("origin", "href")).when(is_http(F.col("href")), F.col("href"))
        return hrefs.select("url", link.alias("link")).where("link IS NOT NULL")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def links(urls, bodies):
        import pandas as pd

        return pd.Series([links_of(u, b) if u is not None else [] for u, b in zip(urls, bodies, strict=True)])

    return rows.select("url", F.explode(links("url", _cut(F.col("html")))).alias("link"))


def enrich(urls: DataFrame, *, probes: DataFrame | None = None, pages: DataFrame | None = None, include=(), exclude=(), accept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``url, status``: checked URLs (all, if nothing is checked) and the links found on them, one row for each URL.

    ``accept`` makes of found links (a table of ``url``) those that count, by the rules of the primary rows.
    """
    base = check_status(urls, probes, include, exclude) if probes is not None else urls.select("url").distinct().withColumn("status", F.lit(None).cast("string"))
    if pages is None:
        return keep_status(base)
    links = extract_links(pages.join(urls.select("url").distinct(), "url", "left_semi")).select(F.col("link").alias("url"))
    if accept is not None:
        links = accept(links)
    return keep_status(base.unionByName(links.select("url", F.lit(None).cast("string").alias("status"))))
