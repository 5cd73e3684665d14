"""Rules of sending requests, what is asked, and the tree without its optional part."""

import math
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from weir.operators.filters import CaptureFilter
from weir.sources import requests as rq
from weir.sources import transport as tp


def test_retries_and_waits():
    assert [tp.retryable(s) for s in (None, 500, 503, 429, 408, 404, 200, 301)] == [True, True, True, True, True, False, False, False]
    assert tp.waits(3) == [0.5, 1.0, 1.5] and tp.waits(3, ("7", None, "x")) == [7.0, 1.0, 1.5] and tp.waits(0) == []
    assert [tp.retry_after(h) for h in ("5", " 90 ", "Wed, 1 Jan 2025", None, "-1", "")] == [5, 60, None, None, None, None]


def test_rates_and_rotation():
    assert [tp.interval(r) for r in (None, 0, -1, math.nan, 4, 1e-9)] == [0, 0, 0, 0, 0.25, 3600.0]
    assert tp.departures([0, 0, 0, 10], 2) == [0, 0.5, 1.0, 10] and tp.departures([3, 1], None) == [1, 3]
    turns = tp.rotation(["a", " b ", "", "a"])
    assert [next(turns) for _ in range(3)] == ["a", "b", "a"] and next(tp.rotation([]), None) is None


def test_names_and_clients():
    rng = random.Random(1)
    drawn = [tp.user_agent(True, rng) for _ in range(2000)]
    assert tp.user_agent() == tp.POLITE and 0.6 < sum(d in tp.DESKTOP for d in drawn) / 2000 < 0.7
    own = tp.Client(timeout=5, proxy="socks5://p:1", proxy_auth="u:p:w")
    assert own.credentials() == ("u", "p:w") and tp.Client().credentials() is None
    assert tp.for_role(own, "all", "testers") is own and tp.for_role(own, "providers", "testers") == tp.Client() and tp.for_role(own, "providers,testers", "testers") is own
    with pytest.raises(ValueError):
        tp.Client(proxy="ftp://p")


def test_settled_attempts(spark):
    rows = [("a", 0, 503, "x"), ("a", 1, 200, "y"), ("a", 2, 404, "z"), ("b", 0, None, "x"), ("b", 1, 429, "y"), ("b", 2, 500, "z"), ("b", 3, 200, "late"), ("c", 0, 404, "gone"), ("c", 1, 200, "no")]
    pages = spark.createDataFrame([("vt", d, 0, *r) for d, *r in rows], "source string, domain string, page_no int, attempt int, http_status int, body string")
    assert {r.domain: r.body for r in tp.settled(pages, 2).collect()} == {"a": "y", "b": "z", "c": "gone"}
    assert tp.settled(pages.drop("attempt")).count() == len(rows)


def test_requests():
    ask = rq.request
    assert ask("wayback", "e.com", cursor="a b", archive=CaptureFilter("20200101000000")).endswith("url=e.com/*&fl=original&collapse=urlkey&from=20200101000000&limit=50000&showResumeKey=true&resumeKey=a+b")
    assert "url=*.e.com/*" in ask("cc", "e.com", page=-1, subdomains=True) and ask("cc", "e.com", page=-1).endswith("&showNumPages=true") and "/CC-MAIN-2026-17-index?" in ask("cc", "e.com", index="CC-MAIN-2026-17")
    assert [rq.otx_endpoint(d, s) for d, s in (("e.com", False), ("a.e.com", False), ("a.e.com", True), ("localhost", False))] == ["domain", "hostname", "domain", "domain"]
    assert "limit=40&cursor=x%2By" in ask("vt", "e.com", cursor="x+y") and ask("urlscan", "e.com", cursor="1%2C2").endswith("size=100&search_after=1%2C2") and "page=3" in ask("arquivo", "e.com", page=3)
    assert "q=%22e.com%22&per_page=100&page=2" in ask("github", "e.com", page=2) and rq.zoomeye_request("e.com", subdomains=True)["qbase64"] == "c2l0ZToqLmUuY29t"
    assert len(list(rq.well_known("sitemap", "e.com"))) == 6 and list(rq.well_known("robots", "e.com")) == ["https://e.com/robots.txt", "http://e.com/robots.txt"]
    with pytest.raises(ValueError):
        ask("robots", "e.com")


@pytest.mark.parametrize("gone", [("weir/llm", "tests/llm"), ("weir/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_survives_without_llm(tmp_path, gone):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "tree", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = tmp_path / "tree" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and not [k for k in (*q, *o) if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "tree")})
