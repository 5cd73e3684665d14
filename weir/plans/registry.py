"""Queries of the URL engine by name, with their DuckDB counterparts.

All run over the whole of their tables. Captures, the relation that most queries start from, are derived from ``pages``
as SURVEY section 7.3 gives it; literal inputs stand for what the tables don't hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import text as tx
from weir.functions import urls as ux
from weir.operators import attribution as at
from weir.operators import enrich as en
from weir.operators import filters as fl
from weir.operators import hosts as ho
from weir.operators import transform as tr
from weir.plans import sinks
from weir.sources import decode as de
from weir.sources.recorded import PROVIDERS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_CAPTURES = """
  SELECT p.page_id, v.provider,
    CASE v.i WHEN 0 THEN p.url
             WHEN 1 THEN replace(p.url, 'page=2&ref=x', 'ref=x&page=2')
             WHEN 2 THEN concat(regexp_replace(p.url, '[?#].*$', ''), '/')
             ELSE concat(regexp_replace(p.url, '/?([?#].*)?$', ''),
                  CASE p.page_id % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.PNG' WHEN 2 THEN '.pdf'
                                     WHEN 3 THEN '.css?v=1' ELSE '.mp4' END) END AS url,
    CASE (p.page_id * 3 + v.i) % 7 WHEN 0 THEN '404' WHEN 1 THEN '301' WHEN 2 THEN '500' ELSE '200' END AS status,
    CASE (p.page_id * 5 + v.i * 3) % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html'
                                       WHEN 2 THEN 'image/png' ELSE 'text/css' END AS mime,
    concat(CAST(2018 + p.page_id % 7 AS STRING), lpad(CAST(1 + p.page_id % 12 AS STRING), 2, '0'),
           lpad(CAST(1 + p.page_id % 28 AS STRING), 2, '0'), '120000') AS ts
  FROM {pages} p CROSS JOIN (VALUES (0,'Wayback Machine'),(1,'CC (latest)'),(2,'OTX'),(3,'Arquivo.pt')) AS v(i, provider)
  WHERE (p.page_id + v.i) % 3 <> 0"""
#: Extension, host, path, query and normal form in DuckDB, for the URLs of this corpus.
_X = "nullif(lower(regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/[^/]+[.]([^./]*)$', 1)), '')"
_H = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_P = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_Q = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
_FRAG = "regexp_extract(url, '#(.*)$', 1)"
_TOKENS = f"list_filter(string_split({_Q}, '&'), lambda t: t <> '')"
_NORMAL = (
    f"regexp_extract(url, '^https?://[^/?#]*') || CASE WHEN {_P} = '' THEN '/' WHEN length({_P}) > 1 AND {_P} LIKE '%/' THEN left({_P}, length({_P}) - 1) ELSE {_P} END"
    f" || CASE WHEN len({_TOKENS}) > 0 THEN '?' || array_to_string(list_sort({_TOKENS}), '&') ELSE '' END"
    f" || CASE WHEN contains(url, '#') THEN '#' || {_FRAG} ELSE '' END"
)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return spark.sql(_CAPTURES, pages=pages)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).select("url").distinct()


def _sql(body: str) -> str:
    return f"WITH captures AS ({_CAPTURES.format(pages='pages')}) {body}"


def register(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _filter_query(name: str, spec: fl.UrlFilter, condition: str) -> None:
    register(name, _sql(f"SELECT DISTINCT url FROM captures WHERE {condition}"))(lambda spark, d: _urls(spark, d).where(spec.column(F.col("url"))))


_JS, _ALL = fl.FAMILIES["js"], sorted({e for f in fl.FAMILIES.values() for e in f})
_filter_query("f_ext_include", fl.UrlFilter(extensions=("js", "PNG")), f"{_X} IN ('js', 'png')")
_filter_query("f_ext_exclude", fl.UrlFilter(exclude_extensions=("js", "css", "png")), f"coalesce({_X}, '') NOT IN ('js', 'css', 'png')")
_filter_query("f_preset_only_js", fl.UrlFilter().with_presets("only-js"), f"{_X} IN ({_quoted(_JS)})")
_filter_query("f_preset_no_resources", fl.UrlFilter().with_presets("no-resource"), f"coalesce({_X}, '') NOT IN ({_quoted(_ALL)})")
_filter_query("f_patterns_in", fl.UrlFilter(patterns=("/EN/", "ref=x")), "contains(lower(url), '/en/') OR contains(lower(url), 'ref=x')")
_filter_query("f_patterns_ex", fl.UrlFilter(exclude_patterns=("utm_source", ".js")), "NOT contains(lower(url), 'utm_source') AND NOT contains(lower(url), '.js')")
_filter_query("f_length", fl.UrlFilter(min_length=40, max_length=60), "octet_length(encode(url)) BETWEEN 40 AND 60")
_filter_query(
    "f_combined", fl.UrlFilter(extensions=("js", "mp4"), patterns=("example.com",), exclude_patterns=("/de/",), max_length=80),
    f"{_X} IN ('js', 'mp4') AND contains(lower(url), 'example.com') AND NOT contains(lower(url), '/de/') AND octet_length(encode(url)) <= 80",
)


@register("f_cdx_pushdown", _sql("SELECT page_id, provider, url, status, mime, ts FROM captures WHERE ts >= '20190101000000' AND ts <= '20231231235959' AND status IN ('200', '301') AND mime NOT IN ('image/png')"))
def f_cdx_pushdown(spark, sf_dir):
    spec = fl.CaptureFilter("20190101000000", "20231231235959", ("200", "301"), exclude_mime=("image/png",))
    return captures(spark, sf_dir).where(spec.column(F.col("ts"), F.col("status"), F.col("mime")))


@register("f_cdx_dialects", _sql("SELECT page_id, provider, url FROM captures WHERE CASE provider WHEN 'Wayback Machine' THEN status IN ('200', '404') AND status <> '500' WHEN 'OTX' THEN true ELSE status <> '500' END"))
def f_cdx_dialects(spark, sf_dir):
    """Several included statuses reach a classic index, are left out for the others, and nothing is pushed elsewhere."""
    from weir.plans.options import ScanOptions
    from weir.plans.pipeline import captured

    o = ScanOptions(archive=fl.CaptureFilter(status=("200", "404"), exclude_status=("500",)))
    return captured(captures(spark, sf_dir).withColumnRenamed("provider", "source"), o).select("page_id", F.col("source").alias("provider"), "url")


_TARGETS = ["thther.example.org", "ththhe.example.com"]


@register("f_host_strict", _sql(f"SELECT DISTINCT url FROM captures WHERE {_H} IN ({_quoted(_TARGETS)}) OR {_H} IN ({_quoted('www.' + t for t in _TARGETS)})"))
def f_host_strict(spark, sf_dir):
    return ho.host_filter(_urls(spark, sf_dir), _TARGETS)


@register("f_host_subs", _sql(f"SELECT DISTINCT url FROM captures WHERE {_H} = 'example.com' OR {_H} LIKE '%.example.com'"))
def f_host_subs(spark, sf_dir):
    return ho.host_filter(_urls(spark, sf_dir), ["Example.com."], subdomains=True)


@register("j_host_semi", _sql(f"SELECT page_id, url FROM pages p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT {_H} AS host FROM captures WHERE provider = 'Arquivo.pt' AND status = '500') t WHERE regexp_extract(p.url, '^https?://([^/?#]*)', 1) IN (t.host, 'www.' || t.host))"))
def j_host_semi(spark, sf_dir):
    """Targets from a table, the hosts that one source has failed captures of: an equi semi-join on candidate keys, no nested loop."""
    pages = _pages(spark, sf_dir).select("page_id", "url")
    host = ux.parts(F.col("url"))["host"]
    targets = captures(spark, sf_dir).where("provider = 'Arquivo.pt' AND status = '500'").select(host.alias("host")).distinct()
    hosts = pages.select(host.alias("h")).distinct().withColumn("host", F.explode(ho.host_candidates(F.col("h"), False)))
    passing = hosts.join(targets, "host", "left_semi").select("h").distinct()
    return pages.withColumn("h", host).join(passing, "h", "left_semi").select("page_id", "url")


@register("p_normalize", _sql(f"SELECT DISTINCT {_NORMAL} AS url FROM captures"))
def p_normalize(spark, sf_dir):
    return tr.normalize_urls(_urls(spark, sf_dir))


_VIEW = {"host": f"SELECT DISTINCT {_H} AS url FROM captures", "path": f"SELECT DISTINCT {_P} AS url FROM captures WHERE {_P} NOT IN ('', '/')", "param": f"SELECT DISTINCT {_Q} AS url FROM captures WHERE regexp_matches(url, '^[^?#]*[?]')"}
for _kind, _body in _VIEW.items():
    register(f"p_only_{_kind}", _sql(_body))(lambda spark, d, kind=_kind: tr.view(_urls(spark, d), kind))

_MERGED_INPUT = "SELECT DISTINCT regexp_replace(url, '/[0-9]+', '/N') AS url FROM captures"


@register(
    "a_merge_endpoint",
    _sql(f"""
, u AS ({_MERGED_INPUT}), k AS (SELECT url, regexp_extract(url, '^https?://[^/?#]*[^?#]*') || CASE WHEN {_P} = '' THEN '/' ELSE '' END AS key, {_TOKENS} AS tokens FROM u),
g AS (SELECT key, min(url) AS base, count(*) AS n FROM k GROUP BY key),
t AS (SELECT key, token, min(struct_pack(url := url, pos := pos)) AS spot FROM (SELECT key, url, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM k) GROUP BY key, token),
m AS (SELECT key, string_agg(token, '&' ORDER BY spot, token) AS q FROM t GROUP BY key)
SELECT CASE WHEN n = 1 OR q IS NULL THEN base ELSE key || '?' || q || regexp_extract(base, '#.*$') END AS url FROM g LEFT JOIN m USING (key)""".strip()),
)
def a_merge_endpoint(spark, sf_dir):
    urls = captures(spark, sf_dir).select(F.regexp_replace("url", "/[0-9]+", "/N").alias("url"))
    return tr.merge_endpoints(urls)


@register("a_sources", _sql("SELECT url, list_sort(list(DISTINCT provider)) AS sources FROM captures GROUP BY url"))
def a_sources(spark, sf_dir):
    return at.sources_of(captures(spark, sf_dir).withColumnRenamed("provider", "source"))


@register("j_attach_sources", _sql(f"SELECT n.url, coalesce(s.sources, []) AS sources FROM (SELECT DISTINCT {_NORMAL} AS url FROM captures) n LEFT JOIN (SELECT url, list_sort(list(DISTINCT provider)) AS sources FROM captures GROUP BY url) s USING (url)"))
def j_attach_sources(spark, sf_dir):
    scans = captures(spark, sf_dir).withColumnRenamed("provider", "source")
    return at.attach_sources(tr.normalize_urls(scans), scans)


@register("a_stats", _sql("SELECT provider AS name, count(*) AS url_count, count(*) FILTER (WHERE status = '500') AS partial_count, count(*) FILTER (WHERE status = '404') AS error_count FROM (SELECT provider, status FROM captures) GROUP BY provider").replace("count(*) AS url_count", "count(*) FILTER (WHERE status NOT IN ('500', '404')) AS url_count"))
def a_stats(spark, sf_dir):
    kind = F.when(F.col("status") == "500", "partial").when(F.col("status") == "404", "error").otherwise("url")
    return at.source_stats(captures(spark, sf_dir).select(F.col("provider").alias("source"), kind.alias("kind"))).drop("elapsed")


@register("a_events_stats", "SELECT event_type AS name, count(*) AS url_count, sum(CAST(user_id AS DOUBLE)) AS elapsed FROM events GROUP BY event_type")
def a_events_stats(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return at.source_stats(events.select(F.col("event_type").alias("source"), F.col("user_id").cast("double").alias("elapsed"))).select("name", "url_count", "elapsed")


@register("a_complete_domains", _sql(f"SELECT {_H} AS domain FROM captures GROUP BY 1 HAVING count(DISTINCT provider) = 4"))
def a_complete_domains(spark, sf_dir):
    rows = captures(spark, sf_dir).select(F.col("provider").alias("source"), ux.parts(F.col("url"))["host"].alias("domain"))
    return at.complete_domains(rows, 4)


@register("a_collapse_urlkey", _sql("SELECT url, ts, page_id, provider, status, mime FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, page_id, provider, status, mime) AS r FROM captures) WHERE r = 1"))
def a_collapse_urlkey(spark, sf_dir):
    return at.collapse(captures(spark, sf_dir).select("url", "ts", "page_id", "provider", "status", "mime"))


@register("a_dedup_keep_status", _sql("SELECT url, min(CASE WHEN status <> '500' THEN status END) AS status FROM captures GROUP BY url"))
def a_dedup_keep_status(spark, sf_dir):
    return at.keep_status(captures(spark, sf_dir).select("url", F.when(F.col("status") != "500", F.col("status")).alias("status")))


@register("a_drop_ratio", _sql(f"SELECT count(*) AS total, count(*) FILTER (WHERE {_H} LIKE '%.example.com') AS kept, count(*) FILTER (WHERE {_H} NOT LIKE '%.example.com') AS dropped, count(*) FILTER (WHERE {_H} LIKE '%.example.com') * 2 < count(*) AS hint FROM (SELECT DISTINCT url FROM captures)"))
def a_drop_ratio(spark, sf_dir):
    return at.drop_report(_urls(spark, sf_dir), F.endswith(ux.parts(F.col("url"))["host"], F.lit(".example.com")))


@register("d_union_distinct", _sql("SELECT url FROM captures WHERE provider = 'OTX' UNION SELECT url FROM captures WHERE provider = 'Wayback Machine'"))
def d_union_distinct(spark, sf_dir):
    return captures(spark, sf_dir).where(F.col("provider").isin("OTX", "Wayback Machine")).select("url").distinct()


@register("d_incremental", _sql("SELECT url FROM captures WHERE ts >= '20200101000000' EXCEPT SELECT url FROM captures WHERE ts < '20200101000000'"))
def d_incremental(spark, sf_dir):
    rows = captures(spark, sf_dir)
    return at.new_urls(rows.where("ts >= '20200101000000'"), rows.where("ts < '20200101000000'"))


@register("l_cap_rows", _sql("SELECT provider, url FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY url) AS r FROM (SELECT DISTINCT provider, url FROM captures)) WHERE r <= 50"))
def l_cap_rows(spark, sf_dir):
    """The feature is the cap on a source's rows."""
    return at.capped(captures(spark, sf_dir).select("provider", "url").distinct(), 50, "provider", "url")


@register("n_links", "SELECT url, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^https?://[^/?#]+') || href ELSE href END AS link FROM (SELECT url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE href LIKE '/%' OR href LIKE 'http://%' OR href LIKE 'https://%'")
def n_links(spark, sf_dir):
    return en.extract_links(_pages(spark, sf_dir).select("url", "html"))


@register("n_links_parsed", "SELECT url, regexp_extract(url, '^https?://[^/?#]+') || href AS link FROM (SELECT url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE href LIKE '/%'")
def n_links_parsed(spark, sf_dir):
    """By an HTML parser: the same here, where links are plain."""
    return en.extract_links(_pages(spark, sf_dir).select("url", "html"))


@register("n_status_filter", _sql("SELECT page_id, url, status FROM captures WHERE status LIKE '20_' OR status LIKE '3__'"))
def n_status_filter(spark, sf_dir):
    return captures(spark, sf_dir).where(fl.status_filter(F.col("status").cast("int"), ("20x,3XX",), ("200",))).select("page_id", "url", "status")


@register("n_check_status", _sql("SELECT url, CASE code WHEN 200 THEN '200 OK' WHEN 301 THEN '301 Moved Permanently' WHEN 404 THEN '404 Not Found' ELSE 'Status check failed' END AS status FROM (SELECT url, max(CASE WHEN status <> '500' THEN CAST(status AS INT) END) AS code FROM captures GROUP BY url) WHERE code IS NULL OR code <> 404"))
def n_check_status(spark, sf_dir):
    rows = captures(spark, sf_dir)
    probes = rows.where("status <> '500'").select("url", F.col("status").cast("int").alias("http_status"))
    return en.check_status(rows, probes, exclude=("404",))


@register("k_plain_row", _sql("SELECT url || ' [' || status || ']' AS line FROM captures"))
def k_plain_row(spark, sf_dir):
    return sinks.lines(captures(spark, sf_dir).select("url", "status"), "plain")


@register("k_csv_row", _sql("SELECT CASE WHEN regexp_matches(url, '[,\"\\n]') THEN '\"' || replace(url, '\"', '\"\"') || '\"' ELSE url END || ',' || status || ',' || provider AS line FROM captures"))
def k_csv_row(spark, sf_dir):
    return sinks.lines(captures(spark, sf_dir).select("url", "status", F.array("provider").alias("sources")), "csv")


@register("k_jsonl_row", _sql("SELECT '{\"url\":\"' || url || '\",\"status\":\"' || status || '\",\"sources\":[\"' || provider || '\"]}' AS line FROM captures"))
def k_jsonl_row(spark, sf_dir):
    return sinks.lines(captures(spark, sf_dir).select("url", "status", F.array("provider").alias("sources")), "jsonl")


@register("k_host_partition", f"SELECT {_H} AS host, count(*) AS n FROM pages GROUP BY 1")
def k_host_partition(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(sinks.host_name(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def _values(spark: SparkSession, rows: list[str], name: str = "v") -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def _value_sql(rows: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + r.replace("'", "''") + "')" for r in rows) + ") AS t(v)"


_DATES = ["2020", "202003", "2020-03-15", "20200315112233", "20203", "202013", "20200300", "1995", "oops"]


@register("s_cdx_timestamp", f"SELECT v, CASE WHEN ok THEN d || substr('00000101000000', length(d) + 1) END AS first, CASE WHEN ok THEN d || substr('00001231235959', length(d) + 1) END AS last FROM (SELECT v, d, length(d) IN (4, 6, 8, 14) AND left(d, 4) >= '1996' AND (length(d) < 6 OR substr(d, 5, 2) BETWEEN '01' AND '12') AND (length(d) < 8 OR substr(d, 7, 2) BETWEEN '01' AND '31') AS ok FROM (SELECT v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM {_value_sql(_DATES)}))")
def s_cdx_timestamp(spark, sf_dir):
    return _values(spark, _DATES).select("v", tx.cdx_timestamp(F.col("v")).alias("first"), tx.cdx_timestamp(F.col("v"), end=True).alias("last"))


_HOSTS = ["https://example.com/path?q=1#frag", "  EXAMPLE.com.  ", "//cdn.example.com/x", "", "https://", "example.com:8080/x", "http://a.example.com:81/"]


@register("s_target_host", f"SELECT v, nullif(CASE WHEN contains(trim(v), '://') THEN regexp_extract(lower(trim(v)), '^[a-z]+://([^/?#:]+)', 1) ELSE lower(regexp_replace(regexp_extract(regexp_replace(trim(v), '^//', ''), '^([^/?#]*)', 1), '[.]+$', '')) END, '') AS host FROM {_value_sql(_HOSTS)}")
def s_target_host(spark, sf_dir):
    return _values(spark, _HOSTS).select("v", tx.target_host(F.col("v")).alias("host"))


@register("s_text_urls", "SELECT doc_id, v AS url FROM (SELECT doc_id, unnest(string_split_regex(text || ' https://e.org/' || doc_id || ').', '[\\s\"'',]+')) AS w FROM documents), LATERAL (SELECT regexp_replace(w, '[.)\\]}>;:!?`]+$', '') AS v) WHERE regexp_matches(w, '^(?i)https?://e[.]org(/|$)')")
def s_text_urls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat("text", F.lit(" https://e.org/"), F.col("doc_id").cast("string"), F.lit(").")).alias("text"))
    return de.mine_urls(docs, "e.org")


@register("x_catalog", "SELECT * FROM (VALUES " + ", ".join(f"('{p.name}', '{p.label}', '{p.key}')" for p in PROVIDERS.values()) + ") AS t(id, label, api_key)")
def x_catalog(spark, sf_dir):
    return spark.createDataFrame([(p.name, p.label, p.key) for p in PROVIDERS.values()], "id string, label string, api_key string")


@register(
    "x_run",
    _sql(f""", kept AS (SELECT DISTINCT url FROM captures WHERE coalesce({_X}, '') NOT IN ({_quoted(fl.FAMILIES["images"])}) AND ({_H} = 'example.com' OR {_H} LIKE '%.example.com')),
n AS (SELECT DISTINCT {_NORMAL} AS url FROM kept), s AS (SELECT url, list_sort(list(DISTINCT provider)) AS sources FROM captures GROUP BY url)
SELECT url, CAST(NULL AS VARCHAR) AS status, coalesce(sources, []) AS sources FROM n LEFT JOIN s USING (url)"""),
)
def x_run(spark, sf_dir):
    """A whole run by options, with the parser for irregular URLs in the plan."""
    from weir.plans.options import ScanOptions
    from weir.plans.pipeline import run

    o = ScanOptions(presets=("no-images",), subdomains=True, normalize=True, show_sources=True)
    return run(captures(spark, sf_dir).withColumnRenamed("provider", "source"), ["example.com"], o)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts on a domain's hosts in normal form, with the sources that know them, in order."""
    scans = captures(spark, sf_dir).withColumnRenamed("provider", "source")
    urls = scans.select("url").distinct().where(fl.UrlFilter().with_presets("only-js").column(F.col("url")))
    kept = ho.host_filter(urls, ["example.com"], subdomains=True)
    return at.attach_sources(tr.normalize_urls(kept), scans).orderBy("url")


@register("entry_flagship", _sql(f", kept AS (SELECT DISTINCT url FROM captures WHERE {_X} IN ({_quoted(_JS)}) AND {_H} LIKE '%.example.com'), s AS (SELECT url, list_sort(list(DISTINCT provider)) AS sources FROM captures GROUP BY url) SELECT n.url, coalesce(sources, []) AS sources FROM (SELECT DISTINCT {_NORMAL} AS url FROM kept) n LEFT JOIN s USING (url)"))
def entry_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)
