"""Golden vectors of filters, hosts, transforms, captures, links and readers."""

import gzip

import pytest
from pyspark.sql import functions as F

from weir.functions import text as tx
from weir.functions import urls as ux
from weir.operators import attribution as at
from weir.operators import enrich as en
from weir.operators import filters as fl
from weir.operators import hosts as ho
from weir.operators import transform as tr
from weir.sources import decode as de
from weir.sources import files as fi
from weir.sources import recorded as rec

BASE = "https://example.com/"
SET = [BASE + x for x in "home.htm lib.js theme.css pic.png paper.pdf face.woff2 film.mp4 staff/door.php v2/items?id=9 a/b/c/d/e/page.htm .git/HEAD".split()]


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(r,) for r in rows], "url string")


def urls(df):
    return sorted(r.url for r in df.collect())


@pytest.mark.parametrize("spec,n", [
    (fl.UrlFilter(extensions=("js", "php")), 2), (fl.UrlFilter(exclude_extensions=("js", "css", "png")), 8), (fl.UrlFilter(patterns=("staff", "v2/")), 2),
    (fl.UrlFilter(exclude_patterns=("staff", ".git")), 9), (fl.UrlFilter(), 11),
])
def test_filters(frame, spec, n):
    assert frame(SET).where(spec.column(F.col("url"))).count() == n


def test_lengths_are_bytes_and_inclusive(frame):
    rows = ["https://e.com/é", "https://e.com/ab"]
    assert frame(rows).where(fl.UrlFilter(min_length=16, max_length=16).column(F.col("url"))).count() == 2


def test_extension_of_strings_that_are_no_urls(frame):
    rows = ["a.js", "/x/y/b.png", "c.css", "d.txt", "bare", "e.png?v=1"]
    assert frame(rows).where(fl.UrlFilter(extensions=("js", "png")).column(F.col("url"))).count() == 3


def test_presets(frame):
    rows = [BASE + x for x in ("logo.png", "hero.jpg", "app.js", "index.html", "clip.ts")]
    only = lambda *names: urls(frame(rows).where(fl.UrlFilter().with_presets(*names).column(F.col("url"))))
    assert only("only-image") == sorted([BASE + "logo.png", BASE + "hero.jpg"])
    assert BASE + "clip.ts" not in only("no-videos") and only("only-js", "no-videos") == [BASE + "app.js"]
    assert len(fl.PRESETS) == 13
    with pytest.raises(ValueError, match="no-resources"):
        fl.preset("nothing")


def test_hosts(frame):
    rows = ["https://example.com/path", "http://example.com", "https://example.com.", "https://EXAMPLE.com/", "https://.example.com", "https://-example.com", "file:///x", "mailto:a@example.com",
            "data:text/plain,x", "https://", "not-a-url", "https://sub.example.com/path", "https://www.example.com", "https://www.www.example.com", "https://notexample.com", "https://example.com.evil.com"]
    assert len(urls(ho.host_filter(frame(rows), ["example.com"]))) == 5
    assert len(urls(ho.host_filter(frame(rows), ["example.com."], subdomains=True))) == 7
    many = [f"x{i}.test" for i in range(300)] + ["example.com"]
    assert urls(ho.host_filter(frame(rows), many)) == urls(ho.host_filter(frame(rows), ["example.com"]))
    assert urls(ho.host_filter(frame(rows), many, subdomains=True)) == urls(ho.host_filter(frame(rows), ["example.com"], subdomains=True))


@pytest.mark.parametrize("given,want", [
    (["https://e.com/api?b=2&a=1", "https://e.com/api?a=1&b=2"], ["https://e.com/api?a=1&b=2"]),
    (["https://e.com/api/", "https://e.com/api", "https://e.com/path/subpath/", "https://e.com/path/subpath", "https://e.com/"], ["https://e.com/", "https://e.com/api", "https://e.com/path/subpath"]),
    (["https://e.com/?foo", "https://e.com/p?q=a+b"], ["https://e.com/?foo", "https://e.com/p?q=a+b"]),
    (["plain-text", "://start-with-colon", ""], ["", "://start-with-colon", "plain-text"]),
    (["HTTPS://E.com:443/a/../b//?b&&a=1&b#F"], ["https://e.com/b/?a=1&b&b#F"]),
    (["https://user:pw@e.com:8443/p/#f", "https://e.com", "https://e.com/p?"], ["https://e.com/", "https://e.com/p", "https://user:pw@e.com:8443/p#f"]),
])
def test_normal_form(frame, given, want):
    assert urls(tr.normalize_urls(frame(given))) == sorted(want)


def test_normal_form_is_idempotent_and_native_agrees(frame, spark):
    rows = [*SET, "https://e.com/%7Ex?z=1&y=2#q", "http://E.com/x y", "http://e.com:80", "http://1.2.3.4/a"]
    once = tr.normalize_urls(frame(rows))
    assert urls(tr.normalize_urls(once)) == urls(once)
    regular = frame(rows).where(ux.is_regular(F.col("url")))
    assert regular.count() >= 11 and urls(tr.normalize_urls(regular)) == urls(tr.normalize_urls(regular, native=True))
    assert {r.url: ux.serialise(ux.parse(r.url)) for r in regular.collect()} == {r.url: r.url for r in regular.collect()}


def test_views(frame):
    rows = ["https://e.com/", "https://e.com/p?x=1", "https://e.com/q?", "text"]
    assert urls(tr.view(frame(rows), "host")) == ["e.com", "text"] and urls(tr.view(frame(rows), "path")) == ["/p", "/q", "text"]
    assert urls(tr.view(frame(rows), "param")) == ["", "text", "x=1"] and tr.chosen_view(True, True, True) == "host" and tr.chosen_view(False, True, True) == "path"


@pytest.mark.parametrize("given,want", [
    ([f"{BASE}p?param{i}=value{i}" for i in (1, 2, 3)], [f"{BASE}p?param1=value1&param2=value2&param3=value3"]),
    ([f"{BASE}p?next=%2Fadmin%3Fdebug%3D1", f"{BASE}p?ref=home"], [f"{BASE}p?next=%2Fadmin%3Fdebug%3D1&ref=home"]),
    (["http://e.com/p?a", "https://e.com/p?b", "https://e.com:8443/p?c"], ["http://e.com/p?a", "https://e.com/p?b", "https://e.com:8443/p?c"]),
    (["https://u@e.com/p#x", "https://e.com/p"], ["https://e.com/p"]), (["https://e.com/p?", "text"], ["https://e.com/p?", "text"]),
    (["https://e.com/p?a&b", "https://e.com/p?b&c"], ["https://e.com/p?a&b&c"]),
])
def test_merged_endpoints(frame, given, want):
    assert urls(tr.merge_endpoints(frame(given))) == sorted(want)


def test_normalise_then_merge(frame):
    rows = ["https://e.com/api/?a=1", "https://e.com/api?b=2", "https://e.com/api?c=3"]
    assert urls(tr.transform(frame(rows), normalize=True, merge=True)) == ["https://e.com/api?a=1&b=2&c=3"]


def test_capture_filters():
    one = fl.CaptureFilter(status=("200", "301"))
    assert one.query_params(fl.CLASSIC) == "&filter=statuscode:%28200%7C301%29" and one.query_params(fl.PYWB) == "" and one.inert(fl.PYWB) == ["status"]
    assert fl.CaptureFilter(exclude_status=("404", "500")).query_params(fl.PYWB).count("&filter=") == 2


def test_status_patterns(spark):
    ok = lambda p: spark.range(1).where(fl.status_matches(F.lit(200), [p])).count() == 1
    assert all(map(ok, ["2xx", "20x", "2XX", "404, 200"])) and not any(map(ok, ["3xx", "2x", "2xxx", "x", "abc"]))


def test_unresolved_status(spark, frame):
    probes = spark.createDataFrame([("a", 200)], "url string, http_status int")
    check = lambda **kw: {r.url: r.status for r in en.check_status(frame(["a", "b"]), probes, **kw).collect()}
    assert check(include=("200",), exclude=("200",)) == {"a": "200 OK"} and check(exclude=("200",)) == {"b": "Status check failed"} and check() == {"a": "200 OK", "b": "Status check failed"}


def test_links(spark):
    base = "https://example.com/start"
    assert en.links_of(base, "<a href='/relative/path'>x</a><a href=sibling><a href='../parent'>") == ["https://example.com/relative/path", "https://example.com/sibling", "https://example.com/parent"]
    assert en.links_of(base, '<base href="https://cdn.example.com/app/"><base href="/no/"><a href="x">') == ["https://cdn.example.com/app/x"]
    bad = "".join(f'<a href="{h}">' for h in ("javascript:x", "MAILTO:a", "tel:1", "data:x", "#top", " ", "/files/a:b/c.js"))
    assert en.links_of(base, bad) == ["https://example.com/files/a:b/c.js"]
    pages = spark.createDataFrame([(base, "<a href='/x'>", 200, "text/html"), (base, "<a href='/y'>", 404, None), (base, "<a href='/z'>", 200, "image/png"), (base, "<a href='/w'>", 200, None)], "url string, html string, http_status int, content_type string")
    assert sorted(r.link for r in en.extract_links(pages).collect()) == ["https://example.com/w", "https://example.com/x"]


def test_enriched_rows_keep_a_status(spark, frame):
    probes = spark.createDataFrame([("https://e.com/a", 200)], "url string, http_status int")
    pages = spark.createDataFrame([("https://e.com/a", "<a href='/a'><a href='/b.js'><a href='/c'>")], "url string, html string")
    out = {r.url: r.status for r in en.enrich(frame(["https://e.com/a"]), probes=probes, pages=pages, accept=lambda links: links.where(fl.UrlFilter(exclude_extensions=("js",)).column(F.col("url")))).collect()}
    assert out == {"https://e.com/a": "200 OK", "https://e.com/c": None}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.thousands(F.lit(12345))) == "12,345" and one(tx.elapsed_text(F.lit(1.234))) == "1.23s" and one(tx.elapsed_text(F.lit(0.25))) == "250ms"
    assert one(tx.csv_field(F.lit('a"b'))) == '"a""b"' and one(tx.csv_field(F.lit("a\rb"))) == "a\rb" and one(tx.short_error(F.lit("x" * 90 + "\ny"))) == "x" * 80 + "…"
    url, status = tx.split_status(F.lit("https://example.com/a - b/c.pdf - 200 OK"))
    assert (one(url), one(status)) == ("https://example.com/a - b/c.pdf", "200 OK")
    assert one(tx.preview(F.lit("é" * 60))) == "é" * 50 and one(tx.status_text(F.lit(404))) == "404 Not Found"
    assert tx.fingerprint(["ab", "c"]) != tx.fingerprint(["a", "bc"]) and tx.fingerprint([["a"], []]) != tx.fingerprint([[], ["a"]])


def test_readers(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_bytes(data) and str(tmp_path / name)
    text = write("pool.txt", b"https://e.com/a\n\n# no\nhttp://e.com/b\r\nftp://e.com/\nhttps://e.com/\xff\xfe\n")
    warc = write("x.warc", b"WARC/1.0\nwarc-target-uri: https://e.com/1\nWARC-Target-URI: https://e.com/with space\nhttps://e.com/2\nhttp://e.com/3\n")
    team = b"https://e.com/first\nq7|1999 http://e.com/second\n# none\nhttps://e.com/third and more\n"
    packed, odd, named = write("t.gz", gzip.compress(team)), write("urlteam_x", gzip.compress(team)), write("url_team_y", team)
    plain_gz = write("u.gz", team)  # plain text under a packed name
    assert [len(urls(fi.read_files(spark, [p]))) for p in (text, warc, packed, odd, named, plain_gz)] == [3, 3, 3, 3, 3, 3]
    assert {r.source for r in fi.read_files(spark, [text, warc]).collect()} == {"file"}
    with pytest.raises(ValueError, match="bzip2"):
        fi.read_urlteam(spark, write("z.bz2", b"BZh9xx"))
    with pytest.raises(FileNotFoundError):
        fi.read_files(spark, [str(tmp_path / "missing.txt")])
    names = {"a.warc": "warc", "my-warc-dump.bin": "warc", "urlteam-1.gz": "urlteam", "url_team.bz2": "urlteam", "b.gz": "urlteam", "c.txt": "text", "d.list": "text", "e": "text", "a.warc.gz": "urlteam"}
    assert {x: fi.detect_format(x) for x in names} == names
    assert fi.targets(["https://Example.com/x", "example.com.", "//cdn.example.com/x", "e.com:80/x", ""], "# c\nexample.com\nb.org\n") == ["example.com", "cdn.example.com", "e.com:80", "b.org"]


def test_file_caps(spark, tmp_path, monkeypatch):
    """The first URLs of each file, also where it is read in several splits; and which files a cap cut."""
    for name, n in (("long", 5000), ("short", 10)):
        (tmp_path / f"{name}.txt").write_text("".join(f"https://e.com/{name}/{i:05d}\n" for i in range(n)))
    monkeypatch.setattr(fi, "FILE_URLS", 1200)
    monkeypatch.setattr(fi, "LEAST_LINE", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = urls(fi.read_files(spark, [str(tmp_path / "*.txt")]))
        report = {r.file.rpartition("/")[2]: (r.urls, r.url_capped, r.byte_capped) for r in fi.file_report(spark, [str(tmp_path / "*.txt")]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"https://e.com/long/{i:05d}" for i in range(1200)] + [f"https://e.com/short/{i:05d}" for i in range(10)]
    assert report == {"long.txt": (1200, True, False), "short.txt": (10, False, False)}
    monkeypatch.setattr(fi, "FILE_BYTES", 40_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        with pytest.warns(UserWarning, match="long.txt"):
            cut = urls(fi.read_files(spark, [str(tmp_path / "long.txt")]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert 1000 <= len(cut) <= 1200


def page(source, n, body, status=200, domain="e.com", scope=None):
    return (source, domain, scope, n, status, "text/html", body)


def scanned(spark, tmp_path, pages, sources, domains=("e.com",), **kw):
    path = f"{tmp_path}/responses"
    spark.createDataFrame(pages, rec.SCHEMA).write.mode("overwrite").json(path)
    return rec.scan(rec.responses(spark, path), rec.wanted(spark, list(sources), list(domains), **kw))


def test_recorded_scans(spark, tmp_path):
    pages = [
        page("wayback", 0, "http://e.com/a\nhttp://e.com/b\n\nKEY\n"), page("wayback", 1, "", 503), page("vt", 0, "", 500),
        page("otx", 1, '{"url_list":[{"url":"http://e.com/a"}]}', scope="domain"), page("otx", 1, "oops", domain="f.com", scope="domain"),
        page("arquivo", 0, '{"url":"http://e.com/z"}'), page("arquivo", 1, '{"url":"http://e.com/z"}'), page("arquivo", 2, '{"url":"http://e.com/never"}'),
    ]
    rows = scanned(spark, tmp_path, pages, ["wayback", "vt", "otx", "arquivo"], ["e.com", "f.com"])
    stats = {r.name: (r.url_count, r.partial_count, r.error_count) for r in at.source_stats(rows).collect()}
    # nothing at all was recorded of f.com but one bad page
    assert stats == {"Wayback Machine": (2, 1, 1), "VirusTotal": (0, 0, 2), "OTX": (1, 0, 1), "Arquivo.pt": (1, 0, 1)}
    assert rec.label("cc", "CC-MAIN-2026-17") == "CC-MAIN-2026-17" and rec.label("cc", "latest") == "CC (latest)"


def test_every_source_by_every_target(spark):
    rows = rec.wanted(spark, ["cc", "otx", "vt"], ["e.com", "a.e.com", "e.com"], indexes=("latest", "CC-MAIN-2026-17")).collect()
    assert {tuple(r) for r in rows} == {("cc", i, d) for i in ("latest", "CC-MAIN-2026-17") for d in ("e.com", "a.e.com")} | {("otx", "domain", "e.com"), ("otx", "hostname", "a.e.com"), ("vt", None, "e.com"), ("vt", None, "a.e.com")}


def test_a_page_that_wasnt_recorded_counts_as_failed(spark, tmp_path):
    pages = [page("wayback", 0, "http://e.com/a\n\nKEY"), page("cc", -1, '{"pages": 0}', scope="latest"), page("cc", 0, '{"url":"http://e.com/never"}', scope="latest"), page("github", 1, "{}", 422)]
    got = {(r.source, r.kind, r.url) for r in scanned(spark, tmp_path, pages, ["wayback", "cc", "github", "urlscan"]).collect()}
    assert got == {("Wayback Machine", "url", "http://e.com/a"), ("Wayback Machine", "partial", None), ("Urlscan", "error", None)}


def test_scans_read_their_own_files_only(spark, tmp_path):
    path = f"{tmp_path}/table"
    spark.createDataFrame([page("vt", 0, "x"), page("otx", 1, "y")], rec.SCHEMA).write.parquet(path)
    plan = rec.responses(spark, path, "parquet").where("source = 'vt'").select("domain")._jdf.queryExecution().toString()
    assert "EqualTo(source,vt)" in plan and "body" not in plan.partition("ReadSchema")[2]


def test_sitemap_walk(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    docs = [("https://e.com/s.xml", index("http://e.com/t.xml", "https://e.com/s.xml", "https://other.com/u.xml")), ("http://e.com/t.xml", "<urlset><url><loc>https://e.com/1</loc></url></urlset>"),
            ("https://other.com/u.xml", "<urlset><url><loc>https://other.com/2</loc></url></urlset>"), ("https://e.com/m.txt", "https://e.com/3\nx\nhttps://e.com/4\n")]
    table = spark.createDataFrame(docs, "doc_url string, body string")
    roots = spark.createDataFrame([("e.com", "https://e.com/s.xml"), ("e.com", "https://e.com/m.txt")], "domain string, doc_url string")
    assert urls(rec.walk_sitemaps(table, roots)) == ["https://e.com/1", "https://e.com/3", "https://e.com/4"]
    assert urls(rec.walk_sitemaps(table, roots, most=2)) == ["https://e.com/1", "https://e.com/3"]
    assert urls(rec.walk_sitemaps(table, roots, depth=0)) == ["https://e.com/3", "https://e.com/4"]


def test_same_host(spark):
    pairs = {("https://h/a", "http://H/b"): True, ("http://h:443/", "https://h/"): False, ("https://h:443/", "http://h:80/"): True, ("https://h:8080/", "https://h/"): False, ("x", "x"): False}
    rows = spark.createDataFrame([(*k,) for k in pairs], "a string, b string").select("a", "b", rec.same_host(F.col("a"), F.col("b")).alias("same"))
    assert {(r.a, r.b): r.same for r in rows.collect()} == pairs


def test_cursors_and_indexes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(de.latest_index(F.lit('[{"id":"CC-MAIN-2026-17"},{"id":"x"}]'))) == "CC-MAIN-2026-17" and one(de.latest_index(F.lit('[{"id":"CC-MAIN-2026-1"}]'))) is None
    assert one(de.page_count(F.lit('{"pages": 3}'))) == 3 and one(de.page_count(F.lit("no"))) == 1
    assert one(de.urlscan_cursor(F.lit('{"results":[{"sort":["2023-04-01","e com"]}],"has_more":true}'))) == "2023-04-01%2Ce%20com"
    assert one(de.zoomeye_query(F.lit("e.com"), True)) == "c2l0ZToqLmUuY29t" and one(de.otx_continues(F.lit('{"has_next":false,"url_list":[{"url":"x"}]}'))) is False
