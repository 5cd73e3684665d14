"""The corpus pipeline: language identification, near-deduplication, secrets, packing.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import langid, minhash, packing, secrets
from weir.llm.shared import table, unused, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, also where no language could be learned; a missing label is filled with the prediction.

    Null and empty texts and those without letters go, whatever their labels; ids may be null, rows may be repeated.
    """
    learned = docs.where(F.col("doc_id").isNotNull() & ~langid.is_held_out(F.col("doc_id")))
    model = langid.fit(learned, "text", "lang", F.col("doc_id"))
    if not model.langs:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    pred, score = unused(docs, "pred"), unused(docs, "score")
    out = langid.predict(docs, "text", model, pred=pred, score=score).where(F.col(pred) != langid.UNKNOWN)
    return out.withColumn("lang", F.coalesce("lang", pred)).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, with all its columns.

    Texts that are null or have no words are nobody's duplicates, but equal rows of one id stay once. Rows without an
    id go where a near duplicate with an id stays; else one of them stays.
    """
    return minhash.deduplicated(docs, "doc_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind in brackets and ``n_chars`` counted anew where there were any.

    Texts that are null, empty or clean stay as they are; row for row, so ids may be null or repeated.
    """
    spans, clean = unused(docs, "spans"), unused(docs, "clean")
    found = secrets.scan(docs, "text", out=spans)
    found = found.withColumn(clean, secrets.redacted(F.col("text"), F.col(spans)))
    changed = F.size(spans) > 0
    replaced = {"text": F.col(clean), "n_chars": F.when(changed, F.length(clean).cast("long")).otherwise(F.col("n_chars"))}
    return found.withColumns({c: v for c, v in replaced.items() if c in docs.columns}).select(*[f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' ids in windows of at most 1024; null and empty texts have their end id alone.

    Each row is packed by itself, so repeated rows as often as they occur; no rows give none.
    """
    return packing.pack(docs, "doc_id", "text")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL can't express shingle groups by components, nor byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
