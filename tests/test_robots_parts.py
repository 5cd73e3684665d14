"""Robots files of more bytes than are read of one body: recorded in parts, they are scanned whole."""

import json

import duckdb

from weir.plans import scan_queries
from weir.sources import decode
from weir.sources import recorded as rec


def test_query_equals_its_sql_beyond_the_byte_cap(spark, monkeypatch):
    monkeypatch.setattr(decode, "ROBOTS_BYTES", 600)  # less than the rules of some hosts
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    got = scan_queries.QUERIES["sc_robots_scan"](spark, "/root/testdata/sf0.01").select("domain", "source", "kind", "url").collect()
    want = con.execute(f"SELECT domain, source, kind, url FROM ({scan_queries.ORACLES['sc_robots_scan']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_all_parts_of_the_file_that_counts(spark, tmp_path):
    rows = [("e.com", "https", 0, 200, "/a"), ("e.com", "https", 1, 200, "/b"), ("e.com", "https", 2, 404, "/c"), ("e.com", "http", 3, 200, "/d"), ("f.com", "https", 0, 404, "/a"), ("f.com", "http", 0, 200, "/a"), ("f.com", "http", 1, 200, "/b"), ("g.com", "https", 0, 200, "/a")]
    lines = [json.dumps({"source": "robots", "domain": d, "scope": s, "page_no": n, "http_status": status, "body": f"Disallow: {path}\n"}) for d, s, n, status, path in rows]
    (tmp_path / "r.json").write_text("\n".join(lines))
    found = rec.scan(rec.responses(spark, str(tmp_path)), rec.wanted(spark, ["robots"], ["e.com", "f.com"])).collect()
    assert sorted(r.url for r in found) == ["http://f.com/a", "http://f.com/b", "https://e.com/a", "https://e.com/b"]
