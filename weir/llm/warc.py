"""WARC archives: a writer and a Python data source (operator 2).

The writer makes each record's text in the plan and writes it with Spark's text writer, so that archives go to any
file system that Spark knows, under its commit protocol. Records with equal payloads are found by digest: the one
with the smallest id is a ``response``, the others are ``revisit`` records that name it.

The reader plans partitions over files (small ones together), parses a record's headers first, tests pushed filters
on them, and skips the payloads of records that aren't wanted, or of all if no payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from weir.llm.shared import scratch_path, small_or_not, written

#: Bytes of archives for each partition of a scan.
PARTITION_BYTES = 32 << 20
PAGE = "urn:weir:page:"  # a record's id: that, its page id, a colon and its payload's digest
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = (
    "record_type string, page_id bigint, target_uri string, refers_to bigint, payload_bytes bigint, payload_digest string,"
    " digest_ok boolean, headers map<string,string>, payload binary"
)


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8: five hexadecimal digits are four of base 32."""
    digest = F.sha1(F.encode(text, "UTF-8"))
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null. Line ends within a value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit(f"<{PAGE}"), page, F.lit(":"), F.col("digest"), F.lit(">"))


def write(df: DataFrame, path: str, id_col: str, url_col: str, html_col: str, *, compression: str = "gzip") -> None:
    """A record for each row, payload the html in UTF-8 (null: empty), in archives under ``path``.

    Of rows with equal payloads (empty ones too) those with the smallest id are responses and the others revisits of
    it. Rows without an id are revisits where a row with an id has the payload, else responses. Repeated rows give a
    record each. A record's id is made of page id and digest, so that a revisit names its response's; rows without a
    page id have random ones.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("digest", base32_sha1(F.col("html")))
    shared = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    shared = small_or_not(written(shared, "payloads"))
    joined = rows.join(shared, rows["digest"] == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    size = F.octet_length("html")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.coalesce(_record_id(F.col("id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        _line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.col("url")),
        _line("X-Page-ID", F.col("id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", size),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )
    # the text writer's line separator is the second of the two line ends that close a record
    joined.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def archive_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Archives under a folder, or one file, with their sizes, by Spark's own file system layer."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def read(spark: SparkSession, path: str, *, payload: str = "none") -> DataFrame:
    """Records of the archives under ``path`` by the data source below; filters on headers are pushed down.

    ``payload``: ``none`` skips payloads, ``digest`` tests them against their digest, ``bytes`` returns them too.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    files = json.dumps(archive_files(spark, path))
    return spark.read.format("weir_warc").option("files", files).option("payload", payload).load()


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weir_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    #: Columns that headers alone decide.
    HEADER_COLUMNS = ("record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest")

    def __init__(self, options):
        self.files = json.loads(options.get("files") or "[]")
        self.payload = options.get("payload", "none")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes what headers decide; gives the rest back for Spark to apply."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in self.HEADER_COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            else:
                yield f

    def partitions(self):
        out: list[list[str]] = []
        room = 0
        for path, size in self.files:
            if not out or size > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(path)
            room -= size
        return [Files(paths) for paths in out] or [Files([])]

    def wanted(self, row: dict) -> bool:
        for column, how, value in self.tests:
            own = row[column]
            if own is None or how == "in" and own not in value or how == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
        ])
        rows, held = [], 0
        for path in partition.paths:
            for row in self.records(path):
                rows.append(row)
                held += 500 + len(row["payload"] or b"")
                if len(rows) >= 2000 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, path: str) -> Iterator[dict]:
        with opened(path) as stream:
            while (headers := parse_headers(stream)) is not None:
                length = int(headers.get("content-length", 0))
                row = described(headers)
                if not self.wanted(row):
                    skip(stream, length)
                elif self.payload == "none" or row["record_type"] == "revisit":
                    skip(stream, length)
                    yield row
                else:
                    body = http_payload(headers, stream.read(length))
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    row["digest_ok"] = row["payload_digest"] in (None, digest)
                    if row["payload_digest"] is None:
                        row["payload_digest"] = digest
                    row["payload_bytes"] = len(body)
                    row["payload"] = body if self.payload == "bytes" else None
                    yield row


def described(headers: dict[str, str]) -> dict:
    """A record's columns as far as headers tell."""
    number = lambda s: int(s) if s and s.lstrip("-").isdigit() else None
    digest, refers = headers.get("warc-payload-digest"), headers.get("warc-refers-to", "").strip("<>")
    return {
        "record_type": headers.get("warc-type"), "page_id": number(headers.get("x-page-id")), "target_uri": headers.get("warc-target-uri"),
        "refers_to": number(refers.removeprefix(PAGE).partition(":")[0]) if refers.startswith(PAGE) else None, "payload_bytes": number(headers.get("x-payload-length")),
        "payload_digest": digest.rpartition(":")[2] if digest else None, "digest_ok": None, "headers": list(headers.items()), "payload": None,
    }


def parse_headers(stream) -> dict[str, str] | None:
    """Header fields of the next record, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def http_payload(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers, if the block has them."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    return block.partition(b"\r\n\r\n")[2]


def skip(stream, length: int) -> None:
    if stream.seekable():
        stream.seek(length, io.SEEK_CUR)
        return
    while length > 0:
        length -= len(stream.read(min(length, 1 << 20))) or length


class _Gunzipped(io.RawIOBase):
    """The text of a gzip file of one or many members, as a forward stream."""

    def __init__(self, raw):
        self.raw, self.inflate, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, target):
        while True:
            if self.inflate.eof:
                self.rest = self.inflate.unused_data or self.raw.read(1 << 18)
                if not self.rest:
                    return 0
                self.inflate = zlib.decompressobj(31)
            data = self.rest or self.raw.read(1 << 18)
            if not data:
                return 0
            out = self.inflate.decompress(data, len(target))
            self.rest = self.inflate.unconsumed_tail
            if out:
                target[: len(out)] = out
                return len(out)

    def close(self):
        self.raw.close()
        super().close()


def opened(path: str):
    where, name = pafs.FileSystem.from_uri(path)
    raw = where.open_input_file(name)
    magic = raw.read(2)
    raw.seek(0)
    return io.BufferedReader(_Gunzipped(raw) if magic == b"\x1f\x8b" else _Plain(raw), 1 << 18)


class _Plain(io.RawIOBase):
    """A pyarrow file for ``io.BufferedReader``."""

    def __init__(self, raw):
        self.raw = raw

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        return self.raw.seek(offset, whence)

    def tell(self):
        return self.raw.tell()

    def readinto(self, target):
        return self.raw.readinto(target)

    def close(self):
        self.raw.close()
        super().close()


def round_trip(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of archives written and read back.

    A row for each row of ``df``, also for repeated ones and those without an id or url. A null html is an empty
    payload; empty payloads are equal like others. No rows give none. A payload that differs from its digest raises.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "warc")
    write(df, path, id_col, url_col, html_col)
    records = read(spark, path, payload="digest").where(F.col("record_type").isin("response", "revisit"))
    broken = F.raise_error(F.concat(F.lit("a payload differs from its digest, page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))))
    digest = F.when(F.coalesce(F.col("digest_ok"), F.lit(True)), F.col("payload_digest")).otherwise(broken.cast("string"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def oracle() -> str:
    """DuckDB SQL of ``round_trip`` over pages with ids."""
    groups = " || ".join(f"to_base(CAST('0x' || substr(s, {5 * i + 1}, 5) AS BIGINT), 32, 4)" for i in range(8))
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, payload_bytes, translate({groups}, '{HEX32}', '{BASE32}') AS payload_digest, min(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
