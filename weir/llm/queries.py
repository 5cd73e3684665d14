"""Queries ``opN_<name>`` over whole tables, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.llm import bpe, html, langid, minhash, packing, secrets, topk, urlfilter, vectors, warc
from weir.llm.shared import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document's whole text."""
    return secrets.digest(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return minhash.group(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document's whole text."""
    return langid.identify(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate vectors of a label."""
    return vectors.group(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every document's ids in windows of at most 1024."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), "page_id", "url")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", keep_ids=False)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_warc": op2_warc,
    "op3_minhash": op3_minhash,
    "op4_langid": op4_langid,
    "op5_vectors": op5_vectors,
    "op6_packing": op6_packing,
    "op7_html": op7_html,
    "op8_urls": op8_urls,
    "op9_bpe": op9_bpe,
    "op10_topk": op10_topk,
}

ORACLES: dict[str, str] = {
    "op1_secrets": secrets.oracle(),
    "op2_warc": warc.oracle(),
    "op3_minhash": minhash.oracle(),
    "op5_vectors": vectors.oracle(),
    "op8_urls": urlfilter.oracle(),
    "op10_topk": topk.oracle(),
}
