"""A whole run: scan, cache, filter, validate, transform, enrich, attribute."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weir.operators.attribution import attach_sources, drop_report
from weir.operators.enrich import enrich
from weir.operators.hosts import attributed, host_filter
from weir.operators.transform import transform, transform_column
from weir.plans.cache import UrlCache
from weir.plans.options import ScanOptions, inert_archive, validates_hosts
from weir.plans.scratch import written
from weir.sources.recorded import PROVIDERS


def captured(captures: DataFrame, o: ScanOptions) -> DataFrame:
    """Captures that each source's index would return under the run's capture filter; others pass whole."""
    labels = {p.label: p.dialect for p in PROVIDERS.values() if p.dialect}
    keep = F.lit(True)
    for name, dialect in labels.items():
        keep &= (F.col("source") != name) | o.archive.column(F.col("ts"), F.col("status"), F.col("mime"), dialect)
    return captures.where(keep)


def filtered(urls: DataFrame, targets: list[str], o: ScanOptions) -> DataFrame:
    out = urls.select("url").distinct().where(o.url_filter().column(F.col("url")))
    return host_filter(out, targets, subdomains=o.subdomains) if validates_hosts(o) and targets else out


def accepted(links: DataFrame, targets: list[str], o: ScanOptions) -> DataFrame:
    """Found links by the rules of primary rows: filters, hosts, then each one's own transform (merging needs them all)."""
    out = filtered(links, targets, o).select(transform_column(F.col("url"), normalize=o.normalize, show=o.view()).alias("url"))
    return out.where("url IS NOT NULL").distinct()


def drop_hint(urls: DataFrame, targets: list[str], o: ScanOptions) -> str | None:
    """Advice where host validation drops all or most of the URLs and subdomains aren't wanted."""
    if not validates_hosts(o) or not targets or o.subdomains:
        return None
    kept = host_filter(urls.select("url").distinct(), targets).withColumn("kept", F.lit(True))
    joined = urls.select("url").distinct().join(kept, "url", "left")
    r = drop_report(joined, F.col("kept").isNotNull()).first()
    return f"{r.dropped} of {r.total} URLs are of other hosts; subdomains=True keeps those of subdomains" if r.hint else None


def run(scans: DataFrame, targets: list[str], o: ScanOptions, *, probes: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """``url, status, sources`` of ``scans(url, source)``: one lazy plan."""
    o.validated()
    for why in inert_archive(o):
        warnings.warn(f"the capture filter isn't applied in full: {why}", stacklevel=2)
    out = transform(filtered(scans.where("url IS NOT NULL"), targets, o), normalize=o.normalize, merge=o.merge, show=o.view())
    checks = o.check_status or o.include_status or o.exclude_status
    if checks or o.extract_links:
        found = {"probes": probes if checks else None, "pages": pages if o.extract_links else None}
        out = enrich(out, **found, include=o.include_status, exclude=o.exclude_status, accept=lambda links: accepted(links, targets, o))
    else:
        out = out.withColumn("status", F.lit(None).cast("string"))
    if o.show_sources:
        return attach_sources(out, scans.where("url IS NOT NULL"))
    return out.withColumn("sources", F.array().cast("array<string>"))


def observed(df: DataFrame, name: str = "weir") -> tuple[DataFrame, Observation]:
    """``df`` with running totals that its first action fills: rows, and rows of each kind where it has kinds."""
    seen = Observation(name)
    totals = [F.count(F.lit(1)).alias("rows")]
    if "kind" in df.columns:
        totals += [F.count_if(F.col("kind") == kind).alias(kind) for kind in ("url", "partial", "error")]
    return df.observe(seen, *totals), seen


def run_cached(cache: UrlCache | None, scan_domain, domains: list[str], o: ScanOptions) -> DataFrame:
    """``url`` of all domains through the cache: ``scan_domain(domain)`` is called for those without a fresh entry.

    An entry holds the URLs of its domain's hosts only, whatever host validation does to the result. Incremental runs
    always scan, give the URLs that the last run hadn't, and store the full result even if empty. At the end entries
    that are older than twice their time are removed.
    """
    frames = []
    for domain in domains:
        if cache is None or o.no_cache or o.cache_type == "none":
            frames.append(scan_domain(domain).select("url"))
            continue
        key = o.cache_key(domain)
        if not o.incremental and (hit := cache.get(key, o.cache_ttl)) is not None:
            frames.append(hit)
            continue
        # a scan is read twice, for its entry and for the result
        fresh = written(scan_domain(domain).select("url").distinct(), "scan")
        own = attributed(fresh, domain, subdomains=o.subdomains)
        if o.incremental:
            frames.append(written(cache.new_urls(key, own), "new"))  # before the entry that it is compared with is replaced
            cache.put(key, domain, own, even_empty=True)
        else:
            cache.put(key, domain, own)
            frames.append(fresh)
    if cache is not None and not o.no_cache and o.cache_type != "none":
        # what is given may lie in entries that are removed now
        frames = [written(f, "urls") for f in frames]
        cache.cleanup(o.cache_ttl)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()
