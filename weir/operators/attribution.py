"""Which source saw which URL, and what each source gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sources_of(scans: DataFrame) -> DataFrame:
    """``url, sources``: sorted distinct sources; pairs are made distinct before the shuffle, so hot URLs stay small."""
    return scans.select("url", "source").distinct().groupBy("url").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def attach_sources(final: DataFrame, scans: DataFrame) -> DataFrame:
    """Sources of final rows, by their final spelling; an empty list where no scan gave that spelling."""
    return final.join(sources_of(scans), "url", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def source_stats(scans: DataFrame) -> DataFrame:
    """``name, url_count, partial_count, error_count, elapsed``: rows before any dedup across sources.

    ``kind`` (url, partial, error) and ``elapsed`` are optional columns.
    """
    kind = F.col("kind") if "kind" in scans.columns else F.lit("url")
    elapsed = F.col("elapsed") if "elapsed" in scans.columns else F.lit(0.0)
    return scans.groupBy(F.col("source").alias("name")).agg(
        F.count_if(kind == "url").alias("url_count"), F.count_if(kind == "partial").alias("partial_count"),
        F.count_if(kind == "error").alias("error_count"), F.coalesce(F.sum(elapsed), F.lit(0.0)).alias("elapsed"),
    )


def complete_domains(scans: DataFrame, n_sources: int) -> DataFrame:
    """Domains that all sources have reported on."""
    return scans.groupBy("domain").agg(F.countDistinct("source").alias("n")).where(F.col("n") == n_sources).select("domain")


def collapse(captures: DataFrame, key: str = "url", order: str = "ts") -> DataFrame:
    """The first capture of each key: a minimum of structs, combined before the shuffle, so no key is sorted in one task."""
    others = [c for c in captures.columns if c not in (key, order)]
    return captures.groupBy(key).agg(F.min(F.struct(order, *others)).alias("first")).select(key, f"first.{order}", *[f"first.{c}" for c in others])


def keep_status(rows: DataFrame) -> DataFrame:
    """``url, status``: rows of one URL as one; a known status is kept (the smallest of several)."""
    return rows.groupBy("url").agg(F.min("status").alias("status"))


def new_urls(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct fresh URLs that the cache doesn't hold."""
    return fresh.select("url").distinct().join(cached.select("url"), "url", "left_anti")


def capped(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """At most ``n`` rows for each ``by``, in the order of ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def drop_report(before: DataFrame, keep) -> DataFrame:
    """``total, kept, dropped, hint``: whether all or more than half of the rows fail a condition."""
    counts = before.agg(F.count("*").alias("total"), F.count_if(keep).alias("kept")).withColumn("dropped", F.col("total") - F.col("kept"))
    return counts.withColumn("hint", (F.col("total") > 0) & ((F.col("kept") == 0) | (F.col("dropped") * 2 > F.col("total"))))
