"""Registered queries take URLs in irregular form, too."""

from weir.plans.registry import QUERIES


def test_registered_queries_parse_irregular_urls(spark, tmp_path):
    rows = [(3, "HTTPS://Example.com:8080/a/../b"), (6, "https://user@www.example.com/c"), (9, "https://other.net/d")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    hosts = {r.url for r in QUERIES["f_host_subs"](spark, str(tmp_path)).collect()}
    assert any(":8080" in u for u in hosts) and any("user@" in u for u in hosts) and not any("other" in u for u in hosts)
    assert {r.url for r in QUERIES["p_only_host"](spark, str(tmp_path)).collect()} == {"example.com", "www.example.com", "other.net"}


def test_plans_compile(spark):
    """URL parts are bound once: code that repeats them is too large to be compiled, and Spark would interpret it."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("f_host_subs", "f_ext_exclude", "p_only_path", "a_merge_endpoint", "x_run"):
            assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
