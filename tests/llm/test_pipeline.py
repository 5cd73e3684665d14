"""The pipeline's stages, each against a plain version."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from weir.llm import secrets
from weir.llm.shared import table

from .test_minhash import brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", len(r[1] or ""), "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")


def test_language_stage_drops_only_texts_without_letters(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "12 !", "en", "s", 4), (-3, "the and of", None, "s", 10)], docs.schema)
    out = pipeline.language(spark, docs.unionByName(extra), SF)
    assert out.columns == docs.columns and out.count() == docs.count() + 1
    assert out.where("doc_id = -3").first().lang == "en"
    assert pipeline.language(spark, docs.limit(0), SF).count() == 0


def test_dedup_stage_keeps_one_of_each_group(spark):
    text = "one two three four five six seven"
    rows = [(5, text, "en"), (3, text, "en"), (3, text, "en"), (4, text + " ", "en"), (None, text, "en"), (7, None, "en"), (8, "", "en"), (8, "", "en"), (3, "something else altogether", "en"), (None, "alone", "en"), (None, "alone", "en")]
    out = pipeline.near_duplicates(spark, frame(spark, rows).repartition(3), SF)
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(3, text), (3, "something else altogether"), (7, None), (8, ""), (None, "alone")]))
    assert "extra" in out.columns
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    want = {int(m[1]) for m in (re.match(r"\((\d+), .*True\)", s) for s in brute([(r.doc_id, r.text) for r in docs.collect()])) if m}
    assert kept == want


def test_secret_stage_leaves_none_and_clean_texts_alone(spark):
    rows = [(1, "clean text", "en"), (2, 'a token = "0123456789abcdef0123456789abcdef" b', "en"), (3, None, "en")]
    out = {r.doc_id: (r.text, r.n_chars) for r in pipeline.without_secrets(spark, frame(spark, rows), SF).collect()}
    assert out == {1: ("clean text", 10), 2: ('a [assign]" b', 13), 3: (None, 0)}
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    again = secrets.digest(pipeline.without_secrets(spark, docs, SF), "doc_id", "text")
    assert again.count() == docs.count() and again.where("spans <> ''").count() == 0
    assert secrets.digest(docs, "doc_id", "text").where("spans <> ''").count() > 5


def test_run_packs_what_the_stages_keep(spark):
    docs = table(spark, SF, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "packing"]
    check(pipeline.run(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert docs.where(F.col("text").isNull()).count() == 0
