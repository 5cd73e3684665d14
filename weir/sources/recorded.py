"""Scans over recorded responses: which pages a walk reaches, what they hold, and how the walk ended.

Responses are files (JSON lines or Parquet) of ``source, domain, scope, page_no, http_status, content_type, body``, read
by Spark in as many partitions as the files give. ``scope`` is the index of Common Crawl, the endpoint of OTX, the
scheme of a robots file, the address of a sitemap; else null. ``page_no`` -1 is an index's answer to how many pages it has.
A robots file may be recorded in parts, cut between lines and numbered by ``page_no``; the caps hold for each part.

A walk follows its source's own rule from page to page: cursors, counts, stops, caps. It is found from a few small
values of each page, not from bodies. A scan never fails for a bad page: it emits rows of kind ``url``, ``partial``
(something came before the bad page) or ``error``. A page that should follow and wasn't recorded counts as a bad one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.operators.attribution import capped
from weir.operators.filters import CLASSIC, PYWB
from weir.plans.scratch import small_or_not, written
from weir.sources import decode
from weir.sources.requests import PAGE_ROWS, otx_endpoint, well_known
from weir.sources.transport import RESPONSE_BYTES, settled

SCHEMA = "source string, domain string, scope string, page_no int, http_status int, content_type string, body string"
KEY = ("source", "scope", "domain")
#: Pages of one domain's sitemaps at most, and bytes of one file.
SITEMAP_URLS, SITEMAP_BYTES, SITEMAP_DEPTH = 1_000_000, 50 << 20, 10


@dataclass(frozen=True)
class Provider:
    """A URL source: its label, whether it needs a key, its index dialect, its page cap, its first page, whether it repeats URLs."""

    name: str
    label: str
    key: str = "no"
    dialect: str | None = None
    pages: int = 1
    distinct: bool = True
    first: int = 0


#: The sources, in the order in which scans are built.
PROVIDERS = {
    p.name: p
    for p in (
        Provider("wayback", "Wayback Machine", dialect=CLASSIC, pages=10_000), Provider("cc", "CC (latest)", dialect=PYWB, pages=10_000),
        Provider("otx", "OTX", pages=1000, distinct=False, first=1), Provider("arquivo", "Arquivo.pt", dialect=PYWB, pages=1000),
        Provider("vt", "VirusTotal", key="required", pages=10_000), Provider("urlscan", "Urlscan", key="optional", pages=100, distinct=False),
        Provider("zoomeye", "ZoomEye", key="required", pages=1000, distinct=False, first=1), Provider("github", "GitHub", key="required", pages=10, first=1),
        Provider("robots", "Robots.txt"), Provider("sitemap", "Sitemap", pages=1_000_000),
    )
}


def label(provider: str, index: str | None = None) -> str:
    """A scan's name; scans of several indexes of one source have each their own."""
    if provider == "cc" and index and index != "latest":
        return index if index.startswith("CC-") else f"CC ({index})"
    return PROVIDERS[provider].label


def responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(SCHEMA).format(fmt).load(path)


def wanted(spark: SparkSession, providers: list[str], domains: list[str], *, indexes: tuple[str, ...] = ("latest",), subdomains: bool = False) -> DataFrame:
    """``source, scope, domain`` of every scan: sources by domains, each index of Common Crawl a source of its own."""
    rows = []
    for name in providers:
        for domain in dict.fromkeys(domains):
            scopes = list(dict.fromkeys(indexes)) if name == "cc" else [otx_endpoint(domain, subdomains)] if name == "otx" else [None]
            rows += [(name, scope, domain) for scope in scopes]
    return spark.createDataFrame(rows, "source string, scope string, domain string")


def _ok(pages: DataFrame) -> Column:
    return F.coalesce(F.col("http_status").between(200, 299), F.lit(False)) & (F.coalesce(F.octet_length("body"), F.lit(0)) <= RESPONSE_BYTES)


def page_facts(pages: DataFrame, provider: str) -> DataFrame:
    """``page_no, ok, more, cursor`` of each page of one source: whether it can be read, and whether another is asked for after it.

    ``ok`` is null where an answer says that there is nothing: a walk ends there, and nothing is wrong.
    """
    body, number, ok, none = F.col("body"), F.col("page_no"), _ok(pages), F.lit(None).cast("string")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    if provider == "wayback":
        cursor = decode.resume_key(body)
        some = F.exists(F.split(body, "\n"), lambda x: decode.is_http(F.trim(x)))
        return pages.select(*KEY, "page_no", ok.alias("ok"), (some & cursor.isNotNull()).alias("more"), cursor.alias("cursor"))
    if provider == "cc":
        counts = pages.where((number < 0) & ok).groupBy(*KEY).agg(F.max(decode.page_count(body)).alias("total"))
        rows = pages.where(number >= 0).select(*KEY, "page_no", ok.alias("ok")).join(counts.select(*[F.col(c).alias(f"of_{c}") for c in KEY], "total"), [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in KEY], "left")
        total = F.coalesce("total", F.lit(1))
        rows = rows.where(number < total).select(*KEY, "page_no", "ok", (number + 1 < total).alias("more"), none.alias("cursor"))
        # an index without pages is read to its end
        return rows.unionByName(counts.where("total = 0").select(*KEY, F.lit(0).alias("page_no"), F.lit(None).cast("boolean").alias("ok"), F.lit(False).alias("more"), none.alias("cursor")))
    if provider == "arquivo":
        # a page is followed if it has a URL that no page before it had
        urls = decode.ndjson(pages.where(ok).select(*KEY, "page_no", "body"), http_only=True).groupBy(*KEY, "url").agg(F.min("page_no").alias("page_no"))
        fresh = urls.groupBy(*KEY, "page_no").agg(F.count("*").alias("fresh")).select(*[F.col(c).alias(f"of_{c}") for c in (*KEY, "page_no")], "fresh")
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*KEY, "page_no")]
        return pages.select(*KEY, "page_no", ok.alias("ok")).join(fresh, same, "left").select(*KEY, "page_no", "ok", F.col("fresh").isNotNull().alias("more"), none.alias("cursor"))
    if provider == "otx":
        j = F.from_json(body, "has_next boolean, url_list array<struct<url:string>>")
        n = size(j["url_list"])
        ok, more = ok & j["url_list"].isNotNull(), (n > 0) & (F.coalesce(j["has_next"], F.lit(False)) | (n >= PAGE_ROWS["otx"]))
    elif provider == "vt":
        gone = F.coalesce(F.col("http_status") == 404, F.lit(False))
        j = F.from_json(body, "data array<struct<attributes:struct<url:string>>>, meta struct<cursor:string>")
        cursor = j["meta"]["cursor"]
        ok, more = F.when(~gone, ok & F.rlike(body, F.lit(r"^\s*\{"))), ~gone & (F.coalesce(cursor, F.lit("")) != "")
    elif provider == "urlscan":
        j = F.from_json(body, "results array<struct<sort:array<string>>>")
        ok, more = ok & F.rlike(body, F.lit(r"^\s*\{")), (size(j["results"]) > 0) & decode.urlscan_cursor(body).isNotNull()
    elif provider == "zoomeye":
        j = F.from_json(body, "code int, total bigint, data array<struct<url:string>>")
        urls = F.filter(j["data"]["url"], lambda u: u.isNotNull() & (u != ""))
        ok, more = ok & F.coalesce(j["code"] == 60000, F.lit(False)), (size(urls) > 0) & (number * PAGE_ROWS["zoomeye"] < F.coalesce(j["total"], F.lit(0)))
    elif provider == "github":
        over = F.coalesce(F.col("http_status") == 422, F.lit(False))
        j = F.from_json(body, "items array<struct<text_matches:array<struct<fragment:string>>>>")
        ok, more = F.when(~over, ok & F.rlike(body, F.lit(r"^\s*\{"))), ~over & (size(j["items"]) > 0)
    else:
        raise ValueError(f"{provider!r} isn't walked by pages")
    return pages.select(*KEY, "page_no", ok.alias("ok"), F.coalesce(more, F.lit(False)).alias("more"), none.alias("cursor"))


def walked(pages: DataFrame, provider: str) -> DataFrame:
    """``source, scope, domain, page_no, ok, broken`` of the pages that a walk reaches; ``broken``: it ended there without its rule saying so.

    A source's caps bound the pages of a walk, so a window over one walk's pages is small.
    """
    p = PROVIDERS[provider]
    last = p.first + p.pages - 1
    facts = page_facts(pages.where((F.col("source") == provider) & (F.col("page_no") <= last)), provider).where(F.col("page_no") >= p.first)
    order = Window.partitionBy(*KEY).orderBy("page_no")
    before = lambda c: F.lag(c).over(order)
    # a cursor that comes again leads nowhere
    facts = facts.withColumn("more", F.col("more") & ~F.coalesce(F.col("cursor") == before("cursor"), F.lit(False)) & (F.col("page_no") < last))
    step = (F.col("page_no") == p.first) | F.coalesce((before("page_no") == F.col("page_no") - 1) & before("ok") & before("more"), F.lit(False))
    facts = facts.withColumn("step", step).withColumn("next", F.lead("page_no").over(order))
    facts = facts.withColumn("reached", F.min(F.col("step").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    missing = F.col("more") & ~F.coalesce(F.col("next") == F.col("page_no") + 1, F.lit(False))
    return facts.where("reached").select(*KEY, "page_no", "ok", (~F.coalesce("ok", F.lit(True)) | missing).alias("broken"))


def decoded(pages: DataFrame, provider: str, *, subdomains: bool = False) -> DataFrame:
    """``source, scope, domain, url`` of one source's readable pages."""
    slim = pages.select(*KEY, "body")
    if provider == "wayback":
        out = decode.cdx_text(slim)
    elif provider in ("cc", "arquivo"):
        out = decode.ndjson(slim, http_only=provider == "arquivo")
    elif provider == "github":
        out = decode.github(slim, F.col("domain"), subdomains=subdomains)
    else:
        out = {"otx": decode.otx, "vt": decode.virustotal, "urlscan": decode.urlscan, "zoomeye": decode.zoomeye}[provider](slim)
    return out.select(*KEY, "url")


def _kinds(frame: DataFrame, kind: str) -> DataFrame:
    return frame.withColumn("kind", F.lit(kind))


def scan_one(pages: DataFrame, provider: str, pairs: DataFrame, *, subdomains: bool = False) -> DataFrame:
    """``url, source, scope, domain, kind`` of one source: the URLs of every walk in ``pairs`` and how those ended that broke off."""
    p = PROVIDERS[provider]
    pairs = pairs.where(F.col("source") == provider)
    if provider == "robots":
        # the encrypted file counts where there is one; all its recorded parts do
        good = pages.where((F.col("source") == "robots") & _ok(pages) & F.col("scope").isin("https", "http")).select("domain", F.col("scope").alias("proto"), "body")
        best = written(good.groupBy("domain").agg(F.max("proto").alias("proto")).join(pairs.select("domain"), "domain", "left_semi"), "robots")
        bodies = good.join(small_or_not(best), ["domain", "proto"], "left_semi")
        return _kinds(decode.robots(bodies).select("url", F.lit(provider).alias("source"), F.lit(None).cast("string").alias("scope"), "domain").distinct(), "url")
    if provider == "sitemap":
        documents = pages.where((F.col("source") == "sitemap") & _ok(pages) & (F.octet_length("body") <= SITEMAP_BYTES))
        documents = documents.select(F.col("scope").alias("doc_url"), "body", "content_type")
        roots = pairs.select("domain", F.explode(F.array(*[F.replace(F.lit(u), F.lit("{}"), F.col("domain")) for u in well_known("sitemap", "{}")])).alias("doc_url"))
        found = walk_sitemaps(documents, roots)
        return _kinds(found.select("url", F.lit(provider).alias("source"), F.lit(None).cast("string").alias("scope"), "domain"), "url")
    same = lambda left, right: [left[c].eqNullSafe(right[c]) for c in KEY]
    own = pages.where(F.col("source") == provider)
    own = own.join(small_or_not(pairs), same(own, pairs), "left_semi")
    reached = written(walked(own, provider), "walk")
    readable = reached.where("ok")
    kept = own.join(readable, [*same(own, readable), own["page_no"] == readable["page_no"]], "left_semi")
    rows = decoded(kept, provider, subdomains=subdomains)
    if p.distinct:
        rows = rows.distinct()
    rows = written(rows, "scan")
    counts = rows.groupBy(*KEY).agg(F.lit(True).alias("some"))
    ends = reached.groupBy(*KEY).agg(F.max("broken").alias("broken"), F.max("page_no").alias("at"))
    ends = pairs.join(ends, same(pairs, ends), "left").select(*[pairs[c] for c in KEY], "broken", "at")
    ends = ends.join(counts, same(ends, counts), "left").select(*[ends[c] for c in KEY], "broken", "at", "some")
    # a walk without its first page failed at once
    collected = F.col("at") > p.first if provider == "vt" else F.col("some").isNotNull()
    kind = F.when(F.col("broken").isNull(), F.lit("error")).when(F.col("broken"), F.when(collected, F.lit("partial")).otherwise(F.lit("error")))
    ends = ends.withColumn("kind", kind).where("kind IS NOT NULL")
    return _kinds(rows, "url").unionByName(ends.select(*KEY, F.lit(None).cast("string").alias("url"), "kind")).select("url", *KEY, "kind")


def scan(pages: DataFrame, pairs: DataFrame, *, subdomains: bool = False, retries: int = 2) -> DataFrame:
    """``url, source, domain, kind`` of all walks in ``pairs(source, scope, domain)``, sources by their labels.

    Where several attempts of a request were recorded (column ``attempt``), the retry rule chooses among them.
    """
    pages = settled(pages, retries)
    names = [r.source for r in pairs.select("source").distinct().collect()]  # as many as there are sources
    frames = [scan_one(pages, name, pairs, subdomains=subdomains) for name in PROVIDERS if name in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    shown = F.when((F.col("source") == "cc") & (F.coalesce("scope", F.lit("latest")) != "latest"), F.when(F.startswith("scope", F.lit("CC-")), F.col("scope")).otherwise(F.concat(F.lit("CC ("), "scope", F.lit(")"))))
    labels = F.create_map(*[F.lit(x) for p in PROVIDERS.values() for x in (p.name, p.label)])
    return out.select("url", F.coalesce(shown, F.element_at(labels, F.col("source"))).alias("source"), "domain", "kind")


def same_host(child: Column, parent: Column) -> Column:
    """Host and port equal, a scheme's own port as none; the scheme may differ."""
    whole = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#]+)"

    def bare(c: Column) -> Column:
        at = F.lower(F.regexp_extract(c, whole, 2))
        secure = F.lower(F.regexp_extract(c, whole, 1)) == "https"
        return F.when(secure, F.regexp_replace(at, r":(443)?$", "")).otherwise(F.regexp_replace(at, r":(80)?$", ""))

    return (bare(child) == bare(parent)) & (bare(child) != "")


def walk_sitemaps(documents: DataFrame, roots: DataFrame, *, depth: int = SITEMAP_DEPTH, most: int = SITEMAP_URLS) -> DataFrame:
    """``domain, url``: distinct pages, ``most`` of a domain, under ``roots(domain, doc_url)`` in ``documents(doc_url, body[, content_type])``.

    A frontier of documents is decoded, child sitemaps of the same host that weren't visited make the next one. Each
    round's entries are written, so a round reads the documents of its own frontier only and no plan grows.
    """
    frontier = written(roots.select("domain", "doc_url").distinct(), "frontier")
    visited, pages = frontier, None
    for _ in range(depth + 1):
        entries = written(decode.sitemap(documents.join(frontier, "doc_url")).select("domain", "doc_url", "kind", "url").distinct(), "entries")
        found = entries.where("kind = 'page'").select("domain", "url")
        pages = found if pages is None else pages.unionByName(found)
        children = entries.where("kind = 'sitemap'").where(same_host(F.col("url"), F.col("doc_url"))).select("domain", F.col("url").alias("doc_url")).distinct()
        frontier = written(children.join(visited, ["domain", "doc_url"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    pages = written(pages.distinct(), "pages")
    many = pages.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") > most).select("domain")
    over = pages.join(many, "domain", "left_semi")
    return pages.join(many, "domain", "left_anti").unionByName(capped(over, most, "domain", "url"))
