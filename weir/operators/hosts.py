"""Strict host validation as semi-joins on host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.urls import bound, host_key, parts

#: Targets up to which the test is part of the plan; more are joined by key, and broadcast while few enough.
LITERAL_TARGETS = 200
BROADCAST_TARGETS = 500_000


def host_candidates(host: Column, subdomains: bool) -> Column:
    """The targets that would let a host pass: itself and, without ``subdomains``, itself less ``www.``, else all suffixes."""
    if not subdomains:
        bare = F.when(F.startswith(host, F.lit("www.")), F.substring(host, F.lit(5), F.length(host)))
        return F.array_compact(F.array(host, bare))
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_in(host: Column, keys: list[str], subdomains: bool) -> Column:
    """The same test for a few targets."""
    if not subdomains:
        return host.isin([*keys, *(f"www.{k}" for k in keys)])
    out = host.isin(keys)
    for k in keys:
        out |= F.endswith(host, F.lit(f".{k}"))
    return out


def host_filter(df: DataFrame, targets: list[str], *, subdomains: bool = False, url_col: str = "url", native: bool = False) -> DataFrame:
    """Rows whose URL's host is a target, ``www.`` before one or, with ``subdomains``, anything under one.

    Strings without a host don't pass.
    """
    keys = sorted({t.lower().rstrip(".") for t in targets} - {""})
    host = bound(parts(F.col(url_col), native=native), lambda p: F.when(p["ok"], host_key(p["host"])))
    valid = lambda h: h.isNotNull() & (h != "") & ~F.startswith(h, F.lit(".")) & ~F.startswith(h, F.lit("-"))
    if len(keys) <= LITERAL_TARGETS:
        return df.where(bound(host, lambda h: valid(h) & host_in(h, keys, subdomains)))
    table = df.sparkSession.createDataFrame([(k,) for k in keys], "_target string")
    if len(keys) <= BROADCAST_TARGETS:
        table = F.broadcast(table)
    hosts = df.withColumn("_host", host).where(valid(F.col("_host")))
    # hosts are far fewer than rows: validate each once
    passing = hosts.select("_host").distinct().withColumn("_target", F.explode(host_candidates(F.col("_host"), subdomains))).join(table, "_target", "left_semi").select("_host").distinct()
    return hosts.join(passing, "_host", "left_semi").drop("_host")


def attributed(df: DataFrame, domain: str, *, subdomains: bool, url_col: str = "url") -> DataFrame:
    """The rows that belong to one domain's cache entry."""
    return host_filter(df, [domain], subdomains=subdomains, url_col=url_col)
