"""URL lists in files: text, line-oriented WARC and URLTeam, recognised by name."""

from __future__ import annotations

import gzip
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.functions.text import first_url_token
from weir.functions.urls import is_http
from weir.plans.scratch import small_or_not

#: Caps for each file: URLs and bytes, unpacked; and for each line.
FILE_URLS, FILE_BYTES, LINE_BYTES = 1_000_000, 1 << 30, 1 << 20
#: A URL's line has so many bytes at least, so smaller files can't reach the cap on URLs.
LEAST_LINE = 9

def detect_format(path: str) -> str:
    """``warc``, ``urlteam`` or ``text``: by the last extension, else by words in the name."""
    name = path.rsplit("/", 1)[-1].lower()
    ext = name.rpartition(".")[2] if "." in name[1:] else ""
    by_ext = {"warc": "warc", "gz": "urlteam", "bz2": "urlteam", "txt": "text", "list": "text"}
    if ext in by_ext:
        return by_ext[ext]
    return "warc" if "warc" in name else "urlteam" if "urlteam" in name or "url_team" in name else "text"


def lossy_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``_line, _file, _block``: trimmed lines of each file's first ``FILE_BYTES``, with the start of their split.

    Bytes that aren't UTF-8 become U+FFFD; longer lines are cut. Splits begin at multiples of their size, so that the
    cap falls between two of them; packed files are one split and counted line by line in ``capped_urls``.
    """
    at = F.col("_metadata.file_block_start")
    raw = spark.read.option("lineSep", "\n").text(path).select(F.encode("value", "UTF-8").alias("b"), F.col("_metadata.file_path").alias("_file"), at.alias("_block"))
    text = F.make_valid_utf8(F.decode(F.substring("b", 1, LINE_BYTES), "UTF-8"))
    return raw.where(F.col("_block") < FILE_BYTES).select(F.trim(F.regexp_replace(text, "[\r\n]+$", "")).alias("_line"), "_file", "_block")


def from_text(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("_line").alias("url"), "_file", "_block").where(~F.startswith("url", F.lit("#")) & is_http(F.col("url")))


def from_warc(lines: DataFrame) -> DataFrame:
    """Target headers and bare URL lines, without spaces in the URL."""
    header = F.regexp_extract("_line", r"^(?i)WARC-Target-URI:\s*(.*)$", 1)
    url = F.trim(F.when(F.rlike("_line", F.lit("^(?i)WARC-Target-URI:")), header).otherwise(F.col("_line")))
    return lines.select(url.alias("url"), "_file", "_block").where(is_http(F.col("url")) & ~F.contains("url", F.lit(" ")))


def from_urlteam(lines: DataFrame) -> DataFrame:
    kept = lines.where((F.col("_line") != "") & ~F.startswith("_line", F.lit("#")))
    return kept.select(first_url_token(F.col("_line")).alias("url"), "_file", "_block").where("url IS NOT NULL")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, bytes]]:
    """Files that a path names, with their sizes and first three bytes, by Spark's own file system layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    out = []
    for status in fs.globStatus(where) or []:
        for one in fs.listStatus(status.getPath()):
            if not one.isDirectory():
                stream = fs.open(one.getPath())
                start = [stream.read() for _ in range(3)]
                stream.close()
                out.append((one.getPath().toString(), one.getLen(), bytes(x for x in start if x >= 0)))
    if not out:
        raise FileNotFoundError(path)
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            lines = [x.strip()[:LINE_BYTES] for x in data[:FILE_BYTES].decode("utf-8", "replace").split("\n")]
            for i in range(0, len(lines), 10_000):
                part = lines[i : i + 10_000]
                yield pa.RecordBatch.from_pydict({"_line": pa.array(part, pa.string()), "_file": pa.array([file] * len(part), pa.string()), "_block": pa.array([0] * len(part), pa.int64())})


def urlteam_lines(spark: SparkSession, path: str) -> DataFrame:
    """Gzip or plain text by the first bytes, whatever the name; bzip2 is an error.

    The reader picks its codec by name, so only files whose name and bytes disagree are read as whole binaries.
    """
    found = _files(spark, path)
    if bad := [file for file, _, start in found if start == b"BZh"]:
        raise ValueError(f"bzip2 isn't supported: {', '.join(bad)}")
    odd = [file for file, _, start in found if (start[:2] == b"\x1f\x8b") != file.endswith(".gz")]
    plain = [file for file, _, _ in found if file not in set(odd)]
    frames = [lossy_lines(spark, plain)] if plain else []
    if odd:
        frames.append(spark.read.format("binaryFile").load(odd).select("path", "content").mapInArrow(_unpacked, "_line string, _file string, _block bigint"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_urlteam(spark: SparkSession, path: str) -> DataFrame:
    return from_urlteam(urlteam_lines(spark, path))


def file_urls(spark: SparkSession, path: str) -> DataFrame:
    """``url, _file, _block`` of a path's files, by the format that its name tells."""
    kind = detect_format(path)
    return read_urlteam(spark, path) if kind == "urlteam" else (from_warc if kind == "warc" else from_text)(lossy_lines(spark, path))


def capped_urls(urls: DataFrame, most: int | None = None) -> DataFrame:
    """The first ``most`` URLs (``FILE_URLS``) of each file, in the order of its splits.

    Splits are counted first; how many of each may pass follows from those before it, and a split's own are numbered as
    they are read. No file goes through one task for it.
    """
    most = FILE_URLS if most is None else most
    counts = urls.groupBy("_file", "_block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rooms = counts.select("_file", "_block", F.greatest(F.lit(most) - before, F.lit(0)).alias("room")).where(F.col("room") < F.lit(most))
    first = counts.where((F.col("n") > most) & (F.col("_block") == 0)).select("_file", "_block", F.lit(most).cast("long").alias("room"))
    tight = small_or_not(rooms.unionByName(first))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[tuple, int] = {}
        for batch in batches:
            keep = []
            for key, room in zip(zip(batch.column("_file").to_pylist(), batch.column("_block").to_pylist(), strict=True), batch.column("room").to_pylist(), strict=True):
                n = passed[key] = passed.get(key, 0) + 1
                keep.append(room is None or n <= room)
            yield batch.select(["url", "_file"]).filter(pa.array(keep, pa.bool_()))

    return urls.join(tight, ["_file", "_block"], "left").select("url", "_file", "_block", "room").mapInArrow(number, "url string, _file string")


def file_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, urls, url_capped, byte_capped``: what was read of each file and whether a cap cut it."""
    frame = None
    for path in paths:
        sizes = spark.createDataFrame([(file, size > FILE_BYTES and not file.endswith(".gz")) for file, size, _ in _files(spark, path)], "file string, byte_capped boolean")
        counts = file_urls(spark, path).groupBy(F.col("_file").alias("_f")).agg(F.count("*").alias("n"))
        name = lambda c: F.regexp_replace(c, "^file:/+", "/")
        joined = sizes.join(counts, name(F.col("file")) == name(F.col("_f")), "left")
        one = joined.select("file", F.least(F.coalesce("n", F.lit(0)), F.lit(FILE_URLS)).alias("urls"), F.coalesce(F.col("n") > FILE_URLS, F.lit(False)).alias("url_capped"), "byte_capped")
        frame = one if frame is None else frame.unionByName(one)
    return frame


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``url, source``: every file by its format, all attributed to ``file``; each file's first million URLs and GiB.

    Only files that are large enough to reach a cap are counted; a warning names those that exceed a GiB.
    """
    frames = []
    for path in paths:
        sizes = [(file, size) for file, size, _ in _files(spark, path)]
        if cut := [file for file, size in sizes if size > FILE_BYTES]:
            warnings.warn(f"read to the first {FILE_BYTES} bytes: {', '.join(cut)}", stacklevel=2)
        urls = file_urls(spark, path)
        reach = any(size >= FILE_URLS * LEAST_LINE or file.endswith(".gz") and size * 1000 >= FILE_URLS * LEAST_LINE for file, size in sizes)
        frames.append((capped_urls(urls) if reach else urls).select("url"))
    out = frames[0] if frames else spark.createDataFrame([], "url string")
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("source", F.lit("file"))


def targets(values: list[str], *lists: str) -> list[str]:
    """Hosts of positional targets and of lists' lines, in order of first appearance."""
    from urllib.parse import urlsplit

    out = []
    lines = [*values, *(x for text in lists for x in text.splitlines() if x.strip() and not x.strip().startswith("#"))]
    for line in lines:
        t = line.strip()
        if "://" in t:
            host = (urlsplit(t).hostname or "").lower()
        else:
            t = t.removeprefix("//")
            for mark in "/?#":
                t = t.partition(mark)[0]
            host = t.rstrip(".").lower()
        if host:
            out.append(host)
    return list(dict.fromkeys(out))
