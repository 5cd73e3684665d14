"""Options, cache, sinks and streams."""

import io
import json
import time

import pytest
from pyspark.sql import functions as F

from weir.operators.filters import CaptureFilter
from weir.plans import options as op
from weir.plans import sinks
from weir.plans.cache import UrlCache, expired, open_cache
from weir.plans.options import ScanOptions
from weir.plans.pipeline import drop_hint, observed, run, run_cached
from weir.streaming.stream import Emitted, check_streamable, stream, tallied, tally, write_stream


def frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "url string")


def urls(df):
    return sorted(r.url for r in df.collect())


def test_source_selection():
    assert op.select_sources(ScanOptions()) == ["wayback", "cc", "otx", "robots", "sitemap"]
    assert op.select_sources(ScanOptions(keys=("vt",), exclude_sitemap=True)) == ["wayback", "cc", "otx", "vt", "robots"]
    assert op.select_sources(ScanOptions(providers=("otx", "cc"), exclude_providers=("cc", "robots"))) == ["otx", "sitemap"]
    with pytest.raises(ValueError):
        op.build_sources(ScanOptions(providers=("vt",), exclude_robots=True, exclude_sitemap=True))


@pytest.mark.parametrize("bad", [{"providers": ("nope",)}, {"presets": ("nope",)}, {"network_scope": "moon"}, {"cc_index": ("CC-MAIN-2026-1",)}, {"cache_type": "tape"}, {"rate_limits": ("otx=-1",)}, {"rate_limits": ("otx",)}])
def test_validation(bad):
    with pytest.raises(ValueError):
        ScanOptions(**bad).validated()


CONFIG = """
[output]
format = "CSV"
merge_endpoint = true
nothing = 1
[provider]
providers = ["otx", "vt"]
subs = true
cc_index = "latest, CC-MAIN-2026-17"
from = "2020"
to = "2021-06"
archive_status = ["200"]
vt_api_key = "k1, k2"
include_robots = false
[filter]
preset = ["only-js"]
min_length = 5
show_only_host = true
[network]
rate_limit = 2.0
retries = 4
network_scope = "testers"
[testing]
include_status = ["2xx"]
[cache]
cache_type = "none"
[else]
x = 1
"""


def test_configuration_gives_way():
    o = ScanOptions(subdomains=False, retries=7, presets=("no-images",)).merged(op.load_config(CONFIG)).validated()
    assert (o.format, o.merge, o.providers, o.subdomains, o.cc_index) == ("csv", True, ("otx", "vt"), True, ("latest", "CC-MAIN-2026-17"))
    assert (o.archive.start, o.archive.end, o.archive.status) == ("20200101000000", "20210631235959", ("200",))
    assert (o.presets, o.min_length, o.show_host, o.retries, o.rate_limit, o.cache_type) == (("no-images",), 5, True, 7, 2.0, "none")
    assert o.api_keys == (("vt", "k1"), ("vt", "k2")) and o.exclude_robots and not o.exclude_sitemap and o.include_status == ("2xx",)
    assert op.select_sources(o) == ["otx", "vt", "sitemap"] and op.build_sources(o) == ["otx", "vt", "sitemap"]
    assert ScanOptions(format="jsonl").merged(op.load_config(CONFIG)).format == "jsonl" and op.parse_rate("otx=2.5") == ("otx", 2.5)
    with pytest.warns(UserWarning, match="format"):
        assert ScanOptions().merged({"output": {"format": "xls"}}).format == "plain"
    with pytest.raises(ValueError, match="date"):
        ScanOptions().merged({"provider": {"from": "x"}})


def test_keys_in_their_order():
    config, own = {"provider": {"vt_api_key": "main", "github_api_key": "main"}}, {"github_api_key": "a,b", "zoomeye_api_key": "z", "format": "csv"}
    o = ScanOptions(api_keys=(("urlscan", "given"),)).with_keys({"WEIR_VT_API_KEY": "env, ,env2", "WEIR_URLSCAN_API_KEY": "no"}, own, config)
    assert o.api_keys == (("urlscan", "given"), ("vt", "env"), ("vt", "env2"), ("zoomeye", "z"), ("github", "a"), ("github", "b"))
    turns = o.rotated("github")
    assert [next(turns) for _ in range(3)] == ["a", "b", "a"] and o.format == "plain"


def test_sources_without_their_key_are_named():
    with pytest.warns(UserWarning, match="VirusTotal"):
        assert op.build_sources(ScanOptions(providers=("vt", "cc"), exclude_robots=True, exclude_sitemap=True)) == ["cc"]


def test_inert_capture_filters():
    two = CaptureFilter(status=("200", "301"))
    assert op.inert_archive(ScanOptions(archive=two)) == ["CC (latest) takes one value of status"] and op.inert_archive(ScanOptions()) == []
    assert op.inert_archive(ScanOptions(archive=two, providers=("otx",))) == ["no source is a capture index"] and op.inert_archive(ScanOptions(archive=two, providers=("wayback",))) == []


def test_where_hosts_are_validated():
    assert op.validates_hosts(ScanOptions()) and not any(op.validates_hosts(ScanOptions(**x)) for x in ({"strict": False}, {"files": ("a",)}, {"stdin_only": True}))


def test_hint_about_dropped_hosts(spark):
    df = frame(spark, ["https://a.e.com/1", "https://b.e.com/2", "https://e.com/3"])
    assert "2 of 3" in drop_hint(df, ["e.com"], ScanOptions())
    assert drop_hint(df, ["e.com"], ScanOptions(subdomains=True)) is None and drop_hint(df, ["e.com"], ScanOptions(strict=False)) is None
    assert drop_hint(df.where("url LIKE '%/3'"), ["e.com"], ScanOptions()) is None


def test_found_links_follow_the_rules(spark):
    """Links to other hosts don't pass, and those that do come out as primary rows would."""
    pages = spark.createDataFrame([("https://e.com/p", "<a href='https://other.org/z/?b=2&a=1'><a href='/z/?b=2&a=1'><a href='/x.png'><a href='HTTPS://E.com:443/y'>")], "url string, html string")
    o = ScanOptions(extract_links=True, normalize=True, presets=("no-images",))
    rows = run(pages.select("url", F.lit("s").alias("source")), ["e.com"], o, pages=pages)
    assert urls(rows) == ["https://e.com/p", "https://e.com/y", "https://e.com/z?a=1&b=2"]
    assert "https://other.org/z/?b=2&a=1" in urls(run(pages.select("url", F.lit("s").alias("source")), ["e.com"], ScanOptions(extract_links=True, strict=False), pages=pages))


def test_captures_are_filtered_in_the_scan(spark, tmp_path):
    """The capture filter reaches the files, and only the columns in use are read."""
    spark.createDataFrame([("u", "20200101000000", "200", "text/html", "x")], "url string, ts string, status string, mime string, more string").write.parquet(f"{tmp_path}/c")
    spec = CaptureFilter("20190101000000", "20211231235959", ("200",))
    rows = spark.read.parquet(f"{tmp_path}/c").where(spec.column(F.col("ts"), F.col("status"), F.col("mime"), "pywb")).select("url")
    plan = rows._jdf.queryExecution().toString()
    pushed = plan.partition("PushedFilters: [")[2].partition("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed and "(status" in pushed and "more" not in plan.partition("ReadSchema")[2]


def test_cache_keys_follow_options():
    a = ScanOptions()
    assert a.cache_key("e.com") == ScanOptions(format="csv").cache_key("e.com")
    others = [ScanOptions(**x).cache_key("e.com") for x in ({"subdomains": True}, {"archive": CaptureFilter("2020")}, {"normalize": True}, {"merge": True}, {"cc_index": ("CC-MAIN-2026-17",)})]
    assert len({a.cache_key("e.com"), a.cache_key("f.com"), *others}) == 7


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_cache(spark, tmp_path, fmt):
    cache = UrlCache(spark, f"{tmp_path}/cache", fmt)
    assert cache.get("k", 10) is None and not cache.exists("k")
    cache.put("k", "e.com", frame(spark, ["oak", "elm"]))
    assert urls(cache.get("k", 3600)) == ["elm", "oak"]
    assert urls(cache.new_urls("k", frame(spark, ["elm", "fir", "ash"]))) == ["ash", "fir"]
    cache.put("k", "e.com", frame(spark, []))
    assert urls(cache.baseline("k")) == ["elm", "oak"]
    cache.put("k", "e.com", frame(spark, []), even_empty=True)
    assert cache.exists("k") and urls(cache.baseline("k")) == []
    cache.put("old", "e.com", frame(spark, ["x"]), now=F.lit("2020-01-01 00:00:00").cast("timestamp"))
    assert cache.get("old", 10) is None and not cache.exists("old")
    cache.put("old", "e.com", frame(spark, ["x"]), now=F.lit("2020-01-01 00:00:00").cast("timestamp"))
    assert cache.cleanup(10) == 1 and cache.exists("k")


def test_a_broken_off_replacement_loses_no_entry(spark, tmp_path):
    cache = UrlCache(spark, f"{tmp_path}/cache")
    cache.put("k", "e.com", frame(spark, ["old"]))
    (tmp_path / "cache" / "cache_key=k").rename(tmp_path / "cache" / "_old-k")
    assert urls(cache.baseline("k")) == ["old"]
    cache.put("other", "e.com", frame(spark, ["new"]))
    (tmp_path / "cache" / "cache_key=k").rename(tmp_path / "cache" / "_old-k")
    (tmp_path / "cache" / "cache_key=other").rename(tmp_path / "cache" / "_new-k")
    assert urls(cache.baseline("k")) == ["new"] and not (tmp_path / "cache" / "_old-k").exists()


def test_cache_by_options(spark, tmp_path):
    assert open_cache(spark, ScanOptions(cache_type="none")) is None and open_cache(spark, ScanOptions(no_cache=True)) is None
    assert open_cache(spark, ScanOptions(cache_path=f"{tmp_path}/a")).fmt == "parquet"
    assert open_cache(spark, ScanOptions(cache_type="redis", redis_url=f"{tmp_path}/b")).fmt == "json"
    with pytest.raises(ValueError):
        open_cache(spark, ScanOptions(cache_type="redis"))
    assert urls(run_cached(None, lambda domain: frame(spark, [f"https://{domain}/"]), ["e.com"], ScanOptions())) == ["https://e.com/"]


def test_expiry(spark):
    at = F.lit("2024-01-01 00:00:10").cast("timestamp")
    old = lambda t, ttl: spark.range(1).select(expired(F.lit(t).cast("timestamp"), ttl, at).alias("x")).first().x
    assert old("2024-01-01 00:00:00", 10) and not old("2024-01-01 00:00:00", 11) and old("2024-01-01 00:00:11", 99)


def test_cached_and_incremental_runs(spark, tmp_path):
    cache, calls = UrlCache(spark, f"{tmp_path}/c"), []

    def scan(*paths):
        def go(domain):
            calls.append(domain)
            return frame(spark, [f"https://{domain}/{p}" for p in paths])

        return go

    o = ScanOptions()
    assert urls(run_cached(cache, scan("old"), ["e.com"], o)) == ["https://e.com/old"]
    assert urls(run_cached(cache, scan("other"), ["e.com"], o)) == ["https://e.com/old"] and calls == ["e.com"]
    cache.put("stale", "f.com", frame(spark, ["x"]), now=F.lit("2020-01-01 00:00:00").cast("timestamp"))
    run_cached(cache, scan("old"), ["e.com"], o)
    assert not cache.exists("stale")
    loose = ScanOptions(strict=False)  # entries hold their own hosts' URLs all the same
    assert len(urls(run_cached(cache, lambda d: frame(spark, ["https://g.com/1", "https://evil.org/2"]), ["g.com"], loose))) == 2
    assert urls(cache.baseline(loose.cache_key("g.com"))) == ["https://g.com/1"]
    inc = ScanOptions(incremental=True)
    assert urls(run_cached(cache, scan("old", "new"), ["e.com"], inc)) == ["https://e.com/new"]
    assert urls(run_cached(cache, scan("old", "new"), ["e.com"], inc)) == []


def test_rendered_formats(spark):
    df = spark.createDataFrame([("https://e.com/elm", None, []), ("https://e.com/oak", "200 OK", [])], "url string, status string, sources array<string>")
    assert sinks.render(df, "JSON") == '[{"url":"https://e.com/elm"},{"url":"https://e.com/oak","status":"200 OK"}\n]'
    assert sinks.render(df, "csv") == "url,status\nhttps://e.com/elm,\nhttps://e.com/oak,200 OK\n"
    assert sinks.render(df, "unknown") == "https://e.com/elm\nhttps://e.com/oak [200 OK]\n"
    sources = spark.createDataFrame([("https://e.com/b", "200 OK", ["cc", "otx"]), ("a,b", None, [])], "url string, status string, sources array<string>")
    assert sinks.render(sources, "csv") == 'url,status,sources\n"a,b",,\nhttps://e.com/b,200 OK,cc|otx\n'
    assert sinks.render(df.limit(0), "json") == "[]" and sinks.render(sources, "plain").splitlines()[1] == "https://e.com/b [200 OK] [cc,otx]"


def test_written_formats(spark, tmp_path):
    df = frame(spark, ["https://a.com/1", "https://b.com/2", "not-a-url"])
    for fmt in ("plain", "jsonl", "csv"):
        sinks.write(df, f"{tmp_path}/{fmt}", fmt)
    lines = [x for p in sorted((tmp_path / "csv").glob("part*")) for x in p.read_text().splitlines()]
    assert lines[0] == "url" and "https://a.com/1" in lines and spark.read.json(f"{tmp_path}/jsonl").count() == 3
    sinks.joined(spark, f"{tmp_path}/csv", f"{tmp_path}/one.csv", "csv")
    assert (tmp_path / "one.csv").read_text().splitlines() == ["url", "https://a.com/1", "https://b.com/2", "not-a-url"]
    for rows, want in ((df, [{"url": u} for u in ("https://a.com/1", "https://b.com/2", "not-a-url")]), (df.limit(0), [])):
        sinks.write(rows, f"{tmp_path}/json", "json")
        sinks.joined(spark, f"{tmp_path}/json", f"{tmp_path}/one.json", "json")
        assert json.loads((tmp_path / "one.json").read_text()) == want


@pytest.mark.parametrize("fmt", ["plain", "csv", "json", "jsonl"])
def test_a_file_for_each_host(spark, tmp_path, fmt):
    rows = [(f"https://hot.com/{i:03d}", "200 OK") for i in range(300)] + [("https://b.com/2", None), ("not-a-url", None)]
    sinks.write_by_host(spark.createDataFrame(rows, "url string, status string").repartition(5), f"{tmp_path}/hosts", fmt)
    ext = sinks.FORMATS[fmt]
    files = {p.name: p.read_text() for p in (tmp_path / "hosts").iterdir() if not p.name.startswith(".")}
    assert sorted(files) == [f"_unknown.{ext}", f"b.com.{ext}", f"hot.com.{ext}"]
    hot = files[f"hot.com.{ext}"]
    if fmt == "json":
        assert [r["url"] for r in json.loads(hot)] == [u for u, _ in rows[:300]] and json.loads(files["b.com.json"]) == [{"url": "https://b.com/2"}]
    else:
        lines = hot.splitlines()
        assert len(lines) == 300 + (fmt == "csv") and (fmt != "csv" or lines[0] == "url,status") and lines[-1].count("/299") == 1
        assert [x for x in lines if "/" in x] == sorted(x for x in lines if "/" in x)


def test_shown_rows(spark):
    df = spark.createDataFrame([("https://e.com/b", "404 Not Found"), ("https://e.com/a", "200 OK")], "url string, status string")
    show = lambda **kw: (out := io.StringIO(), sinks.show(df, out=out, **kw))[0].getvalue()
    assert show(silent=True) == "" and show() == "https://e.com/a [200 OK]\nhttps://e.com/b [404 Not Found]\n"
    assert "\x1b[32m200 OK\x1b[0m" in show(colour=True) and "\x1b[31m" in show(colour=True) and "\x1b" not in show(colour=True, fmt="csv")
    assert json.loads(show(fmt="json"))[0]["url"] == "https://e.com/a" and show(fmt="csv").startswith("url,status\n")


def test_running_totals(spark, tmp_path):
    rows, seen = observed(spark.createDataFrame([("a", "url"), ("b", "url"), (None, "error")], "url string, kind string"), "totals")
    rows.write.parquet(f"{tmp_path}/x")
    assert seen.get == {"rows": 3, "url": 2, "partial": 0, "error": 1}


@pytest.mark.parametrize("option", [{"merge": True}, {"check_status": True}, {"include_status": ("2xx",)}, {"extract_links": True}, {"incremental": True}, {"show_sources": True}, {"output_dir": "x"}, {"files": ("x",)}, {"format": "json"}])
def test_stream_conflicts(option):
    with pytest.raises(ValueError, match="can't stream"):
        check_streamable(ScanOptions(**option))


def test_stream_equals_batch(spark, tmp_path):
    rows = [f"https://e.com/p{i % 7}/?b=2&a={i % 3}" for i in range(60)] + ["https://other.org/x", "https://e.com/s.js"]
    for k in range(3):
        spark.createDataFrame([(r, "s") for r in rows[k::3]], "url string, source string").write.parquet(f"{tmp_path}/in/{k}")
    o = ScanOptions(normalize=True, exclude_extensions=("js",), format="jsonl")
    scans = spark.readStream.schema("url string, source string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    emitted = Emitted()
    query = write_stream(stream(tallied(scans), ["e.com"], o), f"{tmp_path}/out", f"{tmp_path}/ck", o, emitted)
    query.awaitTermination()
    assert emitted.rows == 21 and tally(query)["rows"] == len(rows)
    got = sorted(r.url for r in spark.read.json(f"{tmp_path}/out/batch=*").collect())
    batch = run(spark.read.parquet(f"{tmp_path}/in/*"), ["e.com"], ScanOptions(normalize=True, exclude_extensions=("js",)))
    assert got == urls(batch) and len(got) == 21


def test_deadline_keeps_what_has_landed(spark, tmp_path):
    from weir.plans.deadline import collect

    def slow(batches):
        time.sleep(60)
        yield from batches

    good = frame(spark, ["https://e.com/a"])
    bad = frame(spark, ["x"]).withColumn("url", F.raise_error(F.lit("no")).cast("string"))
    scans = {"one": good, "broken": bad, "late": good.mapInArrow(slow, "url string"), "never": good}
    began = time.time()
    out = collect(spark, scans, f"{tmp_path}/scans", max_time=15, parallel=1)
    assert time.time() - began < 50
    assert {(r.url, r.source, r.kind) for r in out.collect()} == {("https://e.com/a", "one", "url"), (None, "broken", "error"), (None, "late", "partial"), (None, "never", "partial")}
