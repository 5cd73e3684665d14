"""Intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few small columns is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset, as in tests, one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        context = spark.sparkContext
        folder = getattr(context, "_weir_shared_dir", None)
        if folder is None:
            folder = context._weir_shared_dir = f"file://{tempfile.mkdtemp(prefix='weir-')}"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/weir-{label}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path by Spark's own file system layer; a stopped session leaves it."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at interpreter exit
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once and the files are columnar and compressed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written or otherwise cheap table) marked for broadcast if its counted rows are within ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df
