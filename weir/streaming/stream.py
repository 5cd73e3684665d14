"""Streaming runs: batches of scans are filtered, transformed, deduplicated over the whole stream and written at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weir.operators.hosts import host_filter
from weir.operators.transform import transform_column
from weir.plans.options import ScanOptions, streaming_conflicts, validates_hosts
from weir.plans.sinks import csv_header, csv_line, known_format, lines
from weir.sources.recorded import PROVIDERS


def check_streamable(o: ScanOptions) -> None:
    """``ValueError`` with all conflicting options and why, before anything is read."""
    if conflicts := streaming_conflicts(o):
        raise ValueError("can't stream with " + "; ".join(f"--{name} ({why})" for name, why in conflicts))


def stream(scans: DataFrame, targets: list[str], o: ScanOptions, *, within: str | None = None, time_col: str = "ts") -> DataFrame:
    """Distinct final ``url`` rows of a streaming ``scans``, first come first.

    The state holds every URL given so far; ``within`` (a duration) bounds it by event time instead.
    """
    check_streamable(o)
    out = scans.where(o.url_filter().column(F.col("url")))
    if validates_hosts(o) and targets:
        out = host_filter(out, targets, subdomains=o.subdomains)
    out = out.withColumn("url", transform_column(F.col("url"), normalize=o.normalize, show=o.view())).where("url IS NOT NULL")
    if within:
        return out.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["url"])
    return out.select("url").dropDuplicates(["url"])


class Emitted:
    """Rows that a stream has written; a batch that is written again counts once."""

    def __init__(self):
        self.batches: dict[int, int] = {}

    @property
    def rows(self) -> int:
        return sum(self.batches.values())


def write_stream(out: DataFrame, path: str, checkpoint: str, o: ScanOptions, emitted: Emitted | None = None):
    """Each batch's lines appended under ``path``, and their number to ``emitted``. Returns the started query.

    CSV has the url column only; its header is a file of its own, there from the start and first in order.
    """
    fmt, counted = known_format(o.format), emitted or Emitted()
    if fmt == "csv":
        spark = out.sparkSession
        spark.createDataFrame([(csv_header(False, False),)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        rows = lines(batch.select("url"), fmt) if fmt != "csv" else batch.select(csv_line(batch, with_status=False, with_sources=False).alias("line"))
        # a batch that is written again after a failure replaces its own folder
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").text(f"{path}/batch={number}")
        counted.batches[number] = seen.get["rows"]

    return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def tallied(scans: DataFrame, name: str = "sources") -> DataFrame:
    """A stream of ``url, source`` that counts each known source's rows as they pass, before anything is dropped."""
    counts = [F.count_if(F.col("source") == p.label).alias(p.name) for p in PROVIDERS.values()]
    return scans.observe(name, F.count(F.lit(1)).alias("rows"), *counts)


def tally(query, name: str = "sources") -> dict[str, int]:
    """The sums of ``tallied`` over the batches whose progress the session keeps."""
    out: dict[str, int] = {}
    for progress in query.recentProgress:
        counts = progress["observedMetrics"].get(name)
        for key, n in counts.asDict().items() if counts else ():
            out[key] = out.get(key, 0) + n
    return out
