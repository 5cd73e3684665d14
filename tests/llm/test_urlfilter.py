"""Operator 8 against a plain Python judgement, its join form and DuckDB."""

import re

import pytest

from weir.llm import urlfilter as uf
from weir.llm.queries import ORACLES, QUERIES

from .oracle import compare

URLS = [
    "http://a.org/es/1", "https://www.example.org/es/x", "https://Example.ORG/en/12?q", "http://example.org/en/2", "http://org/", "http://a.org",
    "http://badexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1#a", "http://x.com/it/", "http://x.net/p", "no scheme", "", None,
    "http://cheap-pills.x.net/a", "https://ads.y.net/", "http://y.net/banners/1", "http://y.net/?u=http://a.org/es/", "http://a.org:80/x", "a b://c.org/\nx?y",
]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in uf.PLACES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.action
    low = re.sub("[A-Z]", lambda c: c[0].lower(), url or "")
    return host, path, None, "block" if any(re.search(p.regex, low) for p in uf.PATTERNS) else "allow"


def test_both_forms_match_plain_judgement(spark):
    rows = [(i if i else None, u, "x") for i, u in enumerate([*URLS, URLS[0]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    want = sorted((str(i), *map(str, plain(u))) for i, u, _ in rows)
    for limit in (2000, 0):
        out = uf.judge(df, "page_id", "url", literal_rules=limit)
        assert sorted(tuple(map(str, r)) for r in out.collect()) == want
    assert uf.judge(df.limit(0), "page_id", "url").count() == 0


def test_index_takes_the_rarest_token(spark):
    df = spark.createDataFrame([(1, "http://example.org/es/"), (2, "http://example.org/a")], "page_id long, url string")
    assert uf.Place("example.org", "/es/", "block").tokens == ("example", "org", "es")
    assert uf.Place("example.org", "/en/1", "block").tokens == ("example", "org", "en")
    index = uf.build_index(df, [uf.Place("example.org", "/es/", "block"), uf.Pattern("ad", "block"), uf.Pattern("||x.net^", "block")])
    assert index == {"es": [0], "": [1], "net": [2]}


def test_allowing_patterns_win(spark):
    df = spark.createDataFrame([(1, "http://ads.good.net/")], "page_id long, url string")
    out = uf.judge(df, "page_id", "url", (), (*uf.PATTERNS, uf.Pattern("||good.net^", "allow")))
    assert [r.verdict for r in out.collect()] == ["allow"]


def test_rule_lists(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! note\n\nblock Bad.org/x\nallow org/\n||Ads.\n@@||ads.good.net^\n||ads.\n# note\n|http://c.net|\n")
    places, patterns = uf.read_rules(spark, str(tmp_path / "rules.txt"))
    assert places == [uf.Place("bad.org", "/x", "block"), uf.Place("org", "/", "allow")]
    assert patterns == [uf.Pattern("||ads.", "block"), uf.Pattern("||ads.good.net^", "allow"), uf.Pattern("|http://c.net|", "block")]
    df = spark.createDataFrame([(1, "http://ads.good.net/"), (2, "http://ads.bad.net/"), (3, "http://bad.org/xy"), (4, "http://ads.x.org/"), (5, "http://c.net"), (6, "http://c.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in uf.judge(df, "page_id", "url", places, patterns).collect()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}
    for bad in ("||x.net^$third-party", "x.net##.banner", "||", "deny x.org/"):
        with pytest.raises(ValueError, match="line 1"):
            uf.parse_rules([bad])


def test_thousands_of_rules(spark):
    """Only a url's own rules run; both forms agree, for null urls and rules without tokens, too."""
    rules = [uf.Pattern(f"||site{i}.test^", "block") for i in range(2500)] + [uf.Pattern("track", "block"), uf.Pattern("||site7.test/free/", "allow")]
    urls = [f"http://a.site{i}.test/p" for i in range(0, 5000, 500)] + ["http://site7.test/free/x", "http://ok.test/tracker", "http://ok.test/", None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {i: "block" if i < 5 or i == 11 else "allow" for i in range(len(urls))}
    for limit in (5000, 10):
        assert {r.page_id: r.verdict for r in uf.judge(df, "page_id", "url", uf.PLACES, rules, literal_rules=limit).collect()} == want
    everything = [uf.Pattern("", "block")]
    assert all({r.verdict for r in uf.judge(df, "page_id", "url", (), everything, literal_rules=n).collect()} == {"block"} for n in (5, 0))
    index = uf.build_index(df, rules)
    assert max(len(ids) for token, ids in index.items() if token) < 5


def test_oracle(spark):
    assert compare(spark, QUERIES["op8_urls"], ORACLES["op8_urls"])
