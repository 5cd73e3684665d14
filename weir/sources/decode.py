"""Recorded response bodies of URL sources into rows.

Each function takes a DataFrame with a ``body`` column and returns ``url`` rows beside the other columns. Malformed
bodies and lines give nothing and never fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.urls import host_key, is_http, parts

#: Caps of robots files: bytes read and entries kept for each body.
ROBOTS_BYTES, ROBOTS_ENTRIES = 1 << 20, 100_000


def _others(df: DataFrame, *more: str) -> list[str]:
    return [c for c in df.columns if c not in ("body", *more)]


def _lines(df: DataFrame) -> DataFrame:
    return df.select(*_others(df), F.explode(F.split("body", "\n")).alias("_line"))


def resume_key(body: Column) -> Column:
    """The cursor of a text page: its last line, if no URL and after a blank line; else null."""
    lines = F.transform(F.split(F.regexp_replace(body, r"\s+$", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    last, before = F.element_at(lines, -1), F.when(F.size(lines) >= 2, F.element_at(lines, -2))
    return F.when((before == "") & (last != "") & ~is_http(last), last)


def cdx_text(df: DataFrame) -> DataFrame:
    """A URL on each line; lines that don't begin with http(s):// are a cursor or junk."""
    return _lines(df).select(*_others(df), F.trim(F.regexp_replace("_line", "\r", "")).alias("url")).where(is_http(F.col("url")))


def ndjson(df: DataFrame, *, http_only: bool = False) -> DataFrame:
    """An object with ``url`` on each line."""
    out = _lines(df).select(*_others(df), F.from_json("_line", "url string")["url"].alias("url")).where("url IS NOT NULL")
    return out.where(is_http(F.col("url"))) if http_only else out


def page_count(body: Column) -> Column:
    """Pages that an index says it has; one if it says nothing readable."""
    return F.coalesce(F.from_json(body, "pages bigint")["pages"], F.lit(1))


def latest_index(catalog: Column) -> Column:
    """The first index of a catalog, if its name is well formed."""
    first = F.get(F.from_json(catalog, "array<struct<id:string>>"), 0)["id"]
    return F.when(F.rlike(first, F.lit("^CC-MAIN-[0-9]{4}-[0-9]{2}$")), first)


def _exploded(df: DataFrame, schema: str, urls) -> DataFrame:
    return df.select(*_others(df), F.explode(urls(F.from_json("body", schema))).alias("url")).where("url IS NOT NULL AND url <> ''")


def otx(df: DataFrame) -> DataFrame:
    schema = "has_next boolean, actual_size int, url_list array<struct<domain:string,url:string,hostname:string,httpcode:int,page_num:int,full_size:int,paged:boolean>>"
    return _exploded(df, schema, lambda j: j["url_list"]["url"])


def otx_continues(body: Column) -> Column:
    """Another page follows unless this one is empty, or short and the last."""
    j = F.from_json(body, "has_next boolean, url_list array<struct<url:string>>")
    n = F.coalesce(F.size(j["url_list"]), F.lit(0))
    return (n > 0) & (F.coalesce(j["has_next"], F.lit(False)) | (n >= 200))


def virustotal(df: DataFrame) -> DataFrame:
    return _exploded(df, "data array<struct<attributes:struct<url:string>>>, meta struct<cursor:string>", lambda j: j["data"]["attributes"]["url"])


def virustotal_cursor(body: Column) -> Column:
    return F.from_json(body, "meta struct<cursor:string>")["meta"]["cursor"]


def urlscan(df: DataFrame) -> DataFrame:
    return _exploded(df, "results array<struct<page:struct<url:string>>>", lambda j: j["results"]["page"]["url"])


def urlscan_cursor(body: Column) -> Column:
    """The last row's sort values joined by commas, for a URL; null on the last page."""
    j = F.from_json(body, "results array<struct<sort:array<string>>>, has_more boolean")
    last = F.try_element_at(j["results"], F.lit(-1))["sort"]
    return F.when(F.coalesce(j["has_more"], F.lit(False)) & (F.size(last) > 0), F.replace(F.url_encode(F.array_join(last, ",")), F.lit("+"), F.lit("%20")))


def zoomeye(df: DataFrame) -> DataFrame:
    """Only answers with code 60000 hold data."""
    schema = "code int, total bigint, data array<struct<url:string,ip:string,domain:string,port:int,title:string>>"
    return _exploded(df, schema, lambda j: F.when(j["code"] == 60000, j["data"]["url"]))


def zoomeye_query(domain: Column, subdomains: bool) -> Column:
    return F.base64(F.encode(F.concat(F.lit("site:*." if subdomains else "site:"), domain), "UTF-8"))


def mine_urls(df: DataFrame, domain: str | Column, *, subdomains: bool = False, text_col: str = "text") -> DataFrame:
    """Distinct URLs of a domain (one, or each row's own) in free text, cut at white space, quotes and commas, closing signs trimmed."""
    token = F.explode(F.split(text_col, r"[\s\"',]+"))
    found = df.select(*[c for c in df.columns if c != text_col], token.alias("url")).where(F.rlike("url", F.lit("^(?i)https?://")))
    found = found.withColumn("url", F.regexp_replace("url", r"[.)\]}>;:!?`]+$", ""))
    p = parts(F.col("url"))
    host, wanted = host_key(p["host"]), host_key(F.lit(domain) if isinstance(domain, str) else domain)
    same = (host == wanted) | F.endswith(host, F.concat(F.lit("."), wanted)) if subdomains else host == wanted
    return found.where(p["ok"] & F.coalesce(same, F.lit(False))).distinct()


def github(df: DataFrame, domain: str | Column, *, subdomains: bool = False) -> DataFrame:
    matches = F.explode(F.from_json("body", "items array<struct<text_matches:array<struct<fragment:string>>>>")["items"])
    texts = df.select(*_others(df), matches.alias("item")).select(*_others(df), F.explode("item.text_matches.fragment").alias("text")).where("text IS NOT NULL")
    return mine_urls(texts, domain, subdomains=subdomains)


def robots(df: DataFrame) -> DataFrame:
    """Disallowed plain paths as URLs of ``proto``, ``domain``; sitemap values as they stand."""
    body = F.decode(F.substring(F.encode("body", "UTF-8"), 1, ROBOTS_BYTES), "UTF-8")

    def entry(line: Column) -> Column:
        name = F.lower(F.trim(F.regexp_extract(line, r"^([^:#]*):", 1)))
        value = F.regexp_extract(line, r"^[^:]*:\s*(\S+)", 1)
        value = F.when(F.startswith(value, F.lit("#")), F.lit("")).otherwise(value)
        path = F.regexp_replace(value, r"[$]$", "")
        plain = F.startswith(path, F.lit("/")) & (path != "/") & ~F.contains(value, F.lit("*"))
        return F.when((name == "disallow") & plain, F.concat("proto", F.lit("://"), "domain", path)).when((name == "sitemap") & (value != ""), value)

    entries = F.filter(F.transform(F.split(body, "\n"), entry), lambda u: u.isNotNull())
    return df.select(*_others(df), F.explode(F.slice(entries, 1, ROBOTS_ENTRIES)).alias("url")).distinct()


_SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"


def sitemap(df: DataFrame) -> DataFrame:
    """``kind`` (page or sitemap) and ``url`` of a sitemap's or index's entries, from ``body`` and ``doc_url``.

    Where the body isn't XML, lines that begin with http count, if the document's name ends in .txt or its
    ``content_type`` is text/plain.
    """
    stripped = F.regexp_replace(F.regexp_replace("body", r"<!--(?s:.*?)-->", ""), r"(</?)[A-Za-z0-9]+:", "$1")
    parsed = F.from_xml(stripped, _SITEMAP, {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"})
    kind_type = F.col("content_type") if "content_type" in df.columns else F.lit(None).cast("string")
    xml = F.rlike("body", F.lit(r"<(?:[A-Za-z0-9]+:)?(urlset|sitemapindex)[\s>]")) & F.rlike("body", F.lit(r"</(?:[A-Za-z0-9]+:)?(urlset|sitemapindex)\s*>\s*$"))
    text = ~xml & (F.endswith(F.lower(F.substring_index("doc_url", "?", 1)), F.lit(".txt")) | F.coalesce(F.startswith(F.lower(kind_type), F.lit("text/plain")), F.lit(False)))
    lines = F.filter(F.transform(F.split("body", "\n"), lambda s: F.trim(F.regexp_replace(s, "\r", ""))), lambda s: F.startswith(s, F.lit("http")))
    entry = lambda kind: lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url"))
    none = F.array().cast("array<struct<kind:string,url:string>>")
    pages = F.transform(F.coalesce(parsed["url"]["loc"], F.array().cast("array<string>")), entry("page"))
    maps = F.transform(F.coalesce(parsed["sitemap"]["loc"], F.array().cast("array<string>")), lambda u: F.struct(F.lit("sitemap").alias("kind"), F.trim(u).alias("url")))
    found = F.when(xml, F.concat(pages, maps)).when(text, F.transform(lines, entry("page"))).otherwise(none)
    return df.select(*_others(df, "content_type"), F.explode(found).alias("_e")).select(*_others(df, "content_type"), "_e.kind", "_e.url").where("url IS NOT NULL")
