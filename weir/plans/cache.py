"""Cached results as a Parquet table partitioned by key, with freshness, differences and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.plans.scratch import shared_dir


def expired(timestamp: Column, ttl: int, now: Column | None = None) -> Column:
    """Whole seconds of age reach the ttl, or the time is in the future."""
    age = F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp(timestamp)
    return (age < 0) | (age >= ttl)


class UrlCache:
    """``cache_key, domain, url, timestamp``; one folder for each key, so a read or write touches that key only.

    Backends differ in the format of their files: ``parquet``, or ``json`` for stores that others read too.
    """

    SCHEMA = "domain string, url string, timestamp timestamp, cache_key string"

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path
        return where, where(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _recover(self) -> None:
        """Put back entries whose replacement was broken off: the new one, where it is whole, else the old one."""
        where, fs = self._fs()
        for status in fs.globStatus(where(f"{self.path}/_old-*")) or []:
            old = status.getPath()
            key = old.getName().removeprefix("_old-")
            target, new = where(f"{self.path}/cache_key={key}"), where(f"{self.path}/_new-{key}")
            if fs.exists(target):
                fs.delete(old, True)
            elif fs.exists(where(f"{self.path}/_new-{key}/_SUCCESS")):
                fs.rename(new, target)
                fs.delete(old, True)
            else:
                fs.rename(old, target)

    def _exists(self) -> bool:
        where, fs = self._fs()
        return fs.exists(where(self.path))

    def table(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        self._recover()
        return self.spark.read.schema(self.SCHEMA).format(self.fmt).load(self.path)

    def get(self, key: str, ttl: int, now: Column | None = None) -> DataFrame | None:
        """A fresh entry's URLs; an expired one is removed."""
        own = self.table().where((F.col("cache_key") == key))
        first = own.select(expired(F.col("timestamp"), ttl, now).alias("old")).limit(1).collect()
        if not first:
            return None
        if first[0].old:
            self.drop(key)
            return None
        return own.where("url IS NOT NULL").select("url")

    def baseline(self, key: str) -> DataFrame:
        """An entry's URLs whatever their age; none if there is no entry."""
        return self.table().where((F.col("cache_key") == key) & F.col("url").isNotNull()).select("url")

    def put(self, key: str, domain: str, urls: DataFrame, *, even_empty: bool = False, now: Column | None = None) -> None:
        """Replace one entry. An empty result is only stored on demand, as an entry without URLs."""
        rows = urls.select(F.lit(domain).alias("domain"), "url").distinct()
        if rows.isEmpty():
            if not even_empty:
                return
            rows = self.spark.createDataFrame([(domain, None)], "domain string, url string")
        stamped = rows.withColumn("timestamp", now if now is not None else F.current_timestamp())
        # written aside, then moved: the entry may be what is being read, and at any time one of the two is there
        where, fs = self._fs()
        target, new, old = (where(f"{self.path}/{name}") for name in (f"cache_key={key}", f"_new-{key}", f"_old-{key}"))
        stamped.write.mode("overwrite").format(self.fmt).save(new.toString())
        fs.delete(old, True)
        if fs.exists(target):
            fs.rename(target, old)
        fs.rename(new, target)
        fs.delete(old, True)

    def exists(self, key: str) -> bool:
        return not self.table().where(F.col("cache_key") == key).isEmpty()

    def drop(self, key: str) -> None:
        where, fs = self._fs()
        fs.delete(where(f"{self.path}/cache_key={key}"), True)

    def new_urls(self, key: str, fresh: DataFrame) -> DataFrame:
        return fresh.select("url").distinct().join(self.baseline(key), "url", "left_anti")

    def cleanup(self, ttl: int, now: Column | None = None) -> int:
        """Remove entries older than twice the ttl; how many."""
        old = [r.cache_key for r in self.table().where(expired(F.col("timestamp"), 2 * ttl, now)).select("cache_key").distinct().collect()]
        for key in old:
            self.drop(key)
        return len(old)


def open_cache(spark: SparkSession, o) -> UrlCache | None:
    """The cache that options name: ``sqlite`` is local Parquet at ``cache_path``, ``redis`` JSON at ``redis_url``, a path that all sessions share; ``none`` has none."""
    if o.no_cache or o.cache_type == "none":
        return None
    if o.cache_type == "redis":
        if not o.redis_url:
            raise ValueError("the shared cache needs redis_url, a path")
        return UrlCache(spark, o.redis_url, "json")
    return UrlCache(spark, o.cache_path or f"{shared_dir(spark)}/weir-cache")
