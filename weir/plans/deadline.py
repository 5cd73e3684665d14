"""Collecting scans under a time limit: what has landed when it is over is kept."""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collect(spark: SparkSession, scans: dict[str, DataFrame], path: str, max_time: float = 0, parallel: int = 5) -> DataFrame:
    """``url, source, kind`` of scans written under ``path``, each in a folder of its own, ``parallel`` at a time.

    With ``max_time`` seconds over, or at a first interrupt, running scans' jobs are cancelled and no further one
    begins; cancelled and skipped scans, and those that fail, give a row of kind ``partial`` or ``error`` instead. A
    second interrupt ends the run. A folder appears only with its scan complete, so no part of a cancelled one is read.
    """
    group = f"weir-{uuid.uuid4().hex}"
    context = spark.sparkContext
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    def land(number: int, name: str, scan: DataFrame) -> tuple[str | None, str | None]:
        if over.is_set():
            return None, "partial"
        try:
            context.setJobGroup(group, "scans", interruptOnCancel=True)
            scan.select("url", F.lit(name).alias("source"), F.lit("url").alias("kind")).write.mode("overwrite").parquet(f"{path}/scan={number}")
            return f"{path}/scan={number}", None
        except Exception:  # noqa: BLE001  one source's failure must not sink the run; it is reported as a row
            return None, "partial" if over.is_set() else "error"
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    timer = threading.Timer(max_time, stop) if max_time > 0 else None
    if timer:
        timer.start()
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        running = {name: pool.submit(land, k, name, scan) for k, (name, scan) in enumerate(scans.items())}
        try:
            wait(running.values())
        except KeyboardInterrupt:
            stop()
            wait(running.values())
        finally:
            if timer:
                timer.cancel()
    ended = {name: task.result() for name, task in running.items()}
    # as literals: a Python worker may have been cut off with a cancelled job, and rows of Python's need one
    none = F.lit(None).cast("string").alias("url")
    notes = [F.struct(none, F.lit(name).alias("source"), F.lit(kind).alias("kind")) for name, (_, kind) in ended.items() if kind]
    empty = F.array().cast("array<struct<url:string,source:string,kind:string>>")
    out = spark.range(1).select(F.inline(F.array(*notes) if notes else empty))
    for folder, _ in ended.values():
        if folder:
            out = out.unionByName(spark.read.schema("url string, source string, kind string").parquet(folder))
    return out
