"""Operator 2: round trips, revisits and pushdown, against plain Python."""

import base64
import gzip
import hashlib

from weir.llm import warc
from weir.llm.queries import ORACLES, QUERIES
from weir.llm.shared import scratch_path

from .oracle import compare

ROWS = [
    (5, "http://a/5", "<p>x</p>"), (3, "http://a/3", "<p>x</p>"), (9, None, None), (8, "http://a/8\r\nEvil: 1", ""), (4, "http://a/4", "é\r\n\r\nWARC/1.1\r\n" * 3),
    (7, "http://a/7", "y" * 300_000), (None, "http://a/n", "<p>x</p>"), (None, "http://a/n", "only"), (3, "http://a/3", "<p>x</p>"), (1, "http://b/1", "z"),
]


def plain(rows):
    out = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        body = (html or "").encode()
        revisit = first is not None and page != first
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip_matches_plain(spark):
    out = warc.round_trip(frame(spark), "page_id", "url", "html")
    assert sorted(str(tuple(r)) for r in out.collect()) == plain(ROWS)
    assert warc.round_trip(frame(spark).limit(0), "page_id", "url", "html").count() == 0


def test_payloads_come_back_whole(spark):
    path = scratch_path(spark, "t")
    warc.write(frame(spark), path, "page_id", "url", "html", compression="none")
    got = {(r.page_id, bytes(r.payload)) for r in warc.read(spark, path, payload="bytes").where("record_type = 'response'").collect()}
    assert {(4, ROWS[4][2].encode()), (7, b"y" * 300_000), (3, b"<p>x</p>"), (8, b"")} <= got


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = scratch_path(spark, "t")
    warc.write(frame(spark), path, "page_id", "url", "html")
    df = warc.read(spark, path, payload="bytes").where("record_type = 'response' AND target_uri LIKE 'http://b/%'")
    assert [r.page_id for r in df.collect()] == [1]
    reader = warc.WarcReader({"files": "[]", "payload": "bytes"})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert [f.attribute for f in kept] == [("payload",)]
    files = [f for f, _ in warc.archive_files(spark, path)]
    seen = [r["record_type"] for f in files for r in reader.records(f)]
    assert set(seen) == {"revisit"} and len(seen) == sum("revisit" in x for x in plain(ROWS))


def test_reads_members_and_bare_payloads(tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    for data in (record(b"one") + record(b"two"), gzip.compress(record(b"one")) + gzip.compress(record(b"two"))):
        (tmp_path / "x.warc").write_bytes(data)
        got = [r["payload"] for r in warc.WarcReader({"payload": "bytes"}).records(f"file://{tmp_path}/x.warc")]
        assert got == [b"one", b"two"]


def test_small_files_share_a_partition():
    reader = warc.WarcReader({"files": '[["a", 1], ["b", 40000000], ["c", 2], ["d", 3]]'})
    assert [p.paths for p in reader.partitions()] == [["a"], ["b"], ["c", "d"]]


def test_oracle(spark):
    assert compare(spark, QUERIES["op2_warc"], ORACLES["op2_warc"])


def test_revisits_name_their_response(spark):
    """By the record's own id, as any reader of archives resolves it."""
    path = scratch_path(spark, "t")
    warc.write(frame(spark, [r for r in ROWS if r[0] is not None]), path, "page_id", "url", "html")
    headers = [r.headers for r in warc.read(spark, path).select("headers").collect()]
    responses = {h["warc-record-id"] for h in headers if h["warc-type"] == "response"}
    revisits = [h for h in headers if h["warc-type"] == "revisit"]
    assert revisits and all(h["warc-refers-to"] in responses for h in revisits)
