"""The cap of robots files counts entries, not lines."""

from pyspark.sql import functions as F

from weir.sources import decode


def test_entries_behind_many_other_lines_are_kept(spark, monkeypatch):
    monkeypatch.setattr(decode, "ROBOTS_ENTRIES", 3)
    body = "#\n" * 10 + "Disallow: /a\nDisallow: /\nDisallow: /a\nAllow: /x\nDisallow: /b\nDisallow: /c"
    df = spark.createDataFrame([("https", "e.com")], "proto string, domain string").withColumn("body", F.lit(body))
    assert sorted(r.url for r in decode.robots(df).collect()) == ["https://e.com/a", "https://e.com/b"]
