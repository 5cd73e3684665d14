"""Result records as plain text, JSON, JSON lines or CSV; one file a host; statistics."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.text import coloured, csv_field, elapsed_text, thousands
from weir.functions.urls import parts as url_parts
from weir.plans.scratch import drop_path, scratch_path, written

FORMATS = {"plain": "txt", "json": "json", "jsonl": "jsonl", "csv": "csv"}


def known_format(name: str) -> str:
    """Any case; what isn't known is plain."""
    low = name.strip().lower()
    return low if low in FORMATS else "plain"


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def plain_line(df: DataFrame) -> Column:
    status, sources = _column(df, "status", "string"), _column(df, "sources", "array<string>")
    return F.concat("url", F.coalesce(F.concat(F.lit(" ["), status, F.lit("]")), F.lit("")), F.when(F.size(sources) > 0, F.concat(F.lit(" ["), F.array_join(sources, ","), F.lit("]"))).otherwise(F.lit("")))


def json_line(df: DataFrame) -> Column:
    """Keys url, status, sources; a null status and empty sources are left out."""
    status, sources = _column(df, "status", "string"), _column(df, "sources", "array<string>")
    return F.to_json(F.struct(F.col("url").alias("url"), status.alias("status"), F.when(F.size(sources) > 0, sources).alias("sources")))


def csv_line(df: DataFrame, *, with_status: bool, with_sources: bool) -> Column:
    fields = [csv_field(F.col("url"))]
    if with_status:
        fields.append(csv_field(_column(df, "status", "string")))
    if with_sources:
        fields.append(csv_field(F.array_join(F.coalesce(_column(df, "sources", "array<string>"), F.array().cast("array<string>")), "|")))
    return F.concat_ws(",", *fields)


def csv_layout(df: DataFrame) -> tuple[bool, bool]:
    """Whether any row has a status, and any has sources: the run's columns."""
    status, sources = _column(df, "status", "string"), _column(df, "sources", "array<string>")
    r = df.agg(F.max(status.isNotNull()).alias("a"), F.max(F.coalesce(F.size(sources) > 0, F.lit(False))).alias("b")).first()
    return bool(r.a), bool(r.b)


def lines(df: DataFrame, fmt: str) -> DataFrame:
    """``line`` of every row, without header or brackets."""
    fmt = known_format(fmt)
    if fmt == "csv":
        status, sources = csv_layout(df)
        return df.select(csv_line(df, with_status=status, with_sources=sources).alias("line"))
    return df.select((plain_line(df) if fmt == "plain" else json_line(df)).alias("line"))


def csv_header(status: bool, sources: bool) -> str:
    return ",".join(["url", *["status"] * status, *["sources"] * sources])


def write(df: DataFrame, path: str, fmt: str = "plain", *, layout: tuple[bool, bool] | None = None) -> None:
    """As part files in byte order of the URLs; ``joined`` makes one file of them.

    The parts of CSV each have the header; its columns are ``layout`` (status, sources) or those that any row fills,
    found over a written copy. The parts of JSON make one array: the first one opens it, the last one closes it.
    """
    fmt = known_format(fmt)
    if fmt == "json":
        rows = written(df.orderBy("url").select(json_line(df).alias("line"), F.monotonically_increasing_id().alias("n")), "array")
        first = rows.agg(F.min("n")).first()[0]
        body = rows.select(F.concat(F.when(F.col("n") == F.lit(first), F.lit("[")).otherwise(F.lit(",")), "line").alias("line"), "n")
        end = df.sparkSession.createDataFrame([("[]" if first is None else "]", (1 << 63) - 1)], "line string, n bigint")
        body.unionByName(end).orderBy("n").select("line").write.mode("overwrite").text(path)
    elif fmt == "csv":
        if layout is None:
            df = written(df, "rows")
            layout = csv_layout(df)
        _csv_writer(df, layout).save(path)
    else:
        lines(df.orderBy("url"), fmt).write.mode("overwrite").text(path)


def _csv_writer(df: DataFrame, layout: tuple[bool, bool], *more: str):
    line = csv_line(df, with_status=layout[0], with_sources=layout[1]).alias(csv_header(*layout))
    ordered = df if more else df.orderBy("url")
    return ordered.select(*more, line).write.mode("overwrite").format("csv").option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01")


def _parts(spark: SparkSession, path: str) -> list:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())


def _stream(spark: SparkSession, parts: list, target: str, head: bytes = b"", tail: bytes = b"", skip_first: int = 0, skip_more: int = 0) -> None:
    """Part files one after the other into ``target``, byte by byte through a small buffer; so many bytes of each left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(target)
    fs = where.getFileSystem(conf)
    out = fs.create(where, True)
    try:
        if head:
            out.write(bytearray(head))
        for i, part in enumerate(parts):
            source = fs.open(part)
            try:
                source.seek(skip_more if i else skip_first)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
        if tail:
            out.write(bytearray(tail))
    finally:
        out.close()


def joined(spark: SparkSession, path: str, target: str, fmt: str = "plain") -> None:
    """The part files that ``write`` made as one file, without a part of it in memory."""
    parts = _parts(spark, path)
    header = 0
    if known_format(fmt) == "csv" and parts:
        stream = parts[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(parts[0])
        header = 1 + next(i for i in range(1 << 20) if stream.read() == 10)
        stream.close()
    _stream(spark, parts, target, skip_more=header)


def render(df: DataFrame, fmt: str = "plain") -> str:
    """The text of a run's single file, made on the driver: for results to be shown."""
    fmt = known_format(fmt)
    own = [r.line for r in lines(df.orderBy("url"), fmt).collect()]
    if fmt == "json":
        return "[" + ",".join(own) + "\n]" if own else "[]"
    if fmt == "csv":
        own = [csv_header(*csv_layout(df)), *own]
    return "".join(x + "\n" for x in own)


def host_name(url: Column) -> Column:
    p = url_parts(url)
    return F.when(p["ok"] & p["host"].isNotNull(), p["host"]).otherwise(F.lit("_unknown"))


def write_by_host(df: DataFrame, path: str, fmt: str = "plain") -> None:
    """A file ``<host>.<ext>`` for each host of the final strings, in order; what isn't a URL goes to ``_unknown``.

    Rows are dealt by ranges of host and URL, so that a host with many rows is written by several tasks. A host's only
    part is renamed; several are joined in order.
    """
    fmt, spark = known_format(fmt), df.sparkSession
    layout = ("status" in df.columns, "sources" in df.columns)
    rows = df.withColumn("host", host_name(F.col("url"))).repartitionByRange("host", "url").sortWithinPartitions("host", "url")
    folder = scratch_path(spark, "hosts")
    header = len(csv_header(*layout)) + 1 if fmt == "csv" else 0
    if fmt == "csv":
        _csv_writer(rows, layout, "host").partitionBy("host").save(folder)
    else:
        line = plain_line(df) if fmt == "plain" else F.concat(F.lit("," if fmt == "json" else ""), json_line(df))
        rows.select("host", line.alias("line")).write.mode("overwrite").partitionBy("host").text(folder)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path
    fs, target = where(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out.mkdirs(target)
    for status in fs.listStatus(where(folder)):
        if not status.isDirectory():
            continue
        host = jvm.java.net.URLDecoder.decode(status.getPath().getName().partition("=")[2], "UTF-8")
        parts, file = _parts(spark, status.getPath().toString()), f"{path}/{host.replace('/', '_')}.{FORMATS[fmt]}"
        out.delete(where(file), True)
        if fmt == "json":
            _stream(spark, parts, file, b"[", b"]\n", skip_first=1)
        elif len(parts) > 1 or not fs.getUri().equals(out.getUri()) or not out.rename(parts[0], where(file)):
            _stream(spark, parts, file, skip_more=header)
    drop_path(spark, folder)


def show(df: DataFrame, fmt: str = "plain", *, silent: bool = False, colour: bool = False, out: TextIO | None = None) -> int:
    """Rows in order to standard output, a partition at a time; nothing if ``silent``. Returns how many.

    ``colour`` marks plain rows' statuses by their class, as files never are.
    """
    if silent:
        return 0
    out, fmt = out or sys.stdout, known_format(fmt)
    if colour and fmt == "plain" and "status" in df.columns:
        df = df.withColumn("status", coloured(F.col("status")))
    if fmt == "csv":
        print(csv_header(*csv_layout(df)), file=out)
    n = 0
    for n, row in enumerate(lines(df.orderBy("url"), fmt).toLocalIterator(), 1):
        print((("[" if n == 1 else ",") if fmt == "json" else "") + row.line, file=out)
    if fmt == "json":
        print("]" if n else "[]", file=out)
    return n


def stats_table(stats: DataFrame) -> DataFrame:
    return stats.select("name", thousands(F.col("url_count")).alias("urls"), thousands(F.col("partial_count")).alias("partial"), thousands(F.col("error_count")).alias("errors"), elapsed_text(F.col("elapsed")).alias("elapsed")).orderBy("name")
