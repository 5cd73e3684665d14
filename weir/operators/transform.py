"""URL sets into URL sets: normal form, merged endpoints, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.urls import bound, normalised, origin, parts, query_tokens, rebuilt


def normalize_urls(df: DataFrame, url_col: str = "url", *, native: bool = False) -> DataFrame:
    """Distinct normal forms."""
    return df.select(normalised(F.col(url_col), native=native).alias("url")).distinct()


def view_column(url: Column, kind: str, *, native: bool = False) -> Column:
    """``host``, ``path`` (but for the root) or ``param`` (the raw query, may be empty); what isn't a URL stays; else null."""

    def shown(p: Column) -> Column:
        own = {"host": p["host"], "path": F.when(p["path"] != "/", p["path"]), "param": p["query"]}[kind]
        return F.when(p["ok"], own).otherwise(url)

    return bound(parts(url, native=native), shown)


def view(df: DataFrame, kind: str, url_col: str = "url", *, native: bool = False) -> DataFrame:
    return df.select(view_column(F.col(url_col), kind, native=native).alias("url")).where("url IS NOT NULL").distinct()


def chosen_view(host: bool, path: bool, param: bool) -> str | None:
    """Host before path before parameters."""
    return "host" if host else "path" if path else "param" if param else None


def merge_endpoints(df: DataFrame, url_col: str = "url", *, native: bool = False) -> DataFrame:
    """One URL for each scheme, host, port and path, with the parameters of all.

    A single URL stays as it is. Of several the first in byte order is the base, in standard spelling; tokens stand in
    the order of their first appearance and only once; without any the base keeps its own query. What isn't a URL stays. Tokens are made distinct before they are gathered, so a hot endpoint moves its distinct tokens only.
    """
    urls = df.select(F.col(url_col).alias("url")).distinct().withColumn("p", parts(F.col("url"), native=native))
    keyed = urls.withColumn("key", bound(F.col("p"), lambda p: F.when(p["ok"], F.concat(origin(p), p["path"])).otherwise(F.col("url"))))
    base = keyed.groupBy("key").agg(F.min(F.struct("url", "p")).alias("base"), F.count("*").alias("n"))
    tokens = keyed.select("key", "url", F.posexplode(query_tokens(F.col("p.query"))).alias("pos", "token"))
    first = tokens.groupBy("key", "token").agg(F.min(F.struct("url", "pos")).alias("at"))
    gathered = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("tokens"))
    p = F.col("base.p")
    query = F.array_join(F.transform("tokens", lambda t: t["token"]), "&")
    merged = F.when((F.col("n") == 1) | ~p["ok"], F.col("base.url")).otherwise(rebuilt(p, p["path"], F.coalesce(query, p["query"])))
    return base.join(gathered, "key", "left").select(merged.alias("url"))


def transform(df: DataFrame, *, normalize: bool = False, merge: bool = False, show: str | None = None, native: bool = False) -> DataFrame:
    """Normal form, then merging, then a view: always in this order."""
    out = df.select("url").distinct()
    if normalize:
        out = normalize_urls(out, native=native)
    if merge:
        out = merge_endpoints(out, native=native)
    return view(out, show, native=native) if show else out


def transform_column(url: Column, *, normalize: bool = False, show: str | None = None) -> Column:
    """The same for one URL, without merging; null drops it."""
    out = normalised(url) if normalize else url
    return view_column(out, show) if show else out
