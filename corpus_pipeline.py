"""A training-data pipeline over ``documents``: five stages, each an operator of mnemospark.llm.

Every stage works on the rows its predecessor wrote and, but for the last, returns the columns
of documents; a stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import common, packing, queries, secrets, simhash, suffix, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on this input, scores 0.5 or more."""
    scored = toxicity.score(docs, toxicity.train(docs, common.labels(spark, sf_dir)))
    return common.in_order(scored.filter("score < 0.5"), docs.columns, F.col("text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group of near copies.

    Near copies share 0.8 of their five-word shingles (Jaccard similarity). Rows without a
    doc_id come after all others, and one of repeated rows stays. A null text counts as empty
    and comes back so.
    """
    rows = common.numbered(docs)
    return common.in_order(rows.join(simhash.near_copies(rows), "rid", "left_semi"), docs.columns, F.col("text"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also start earlier out of the texts.

    A cut may split a code point; its remaining bytes are dropped. Documents whose whole text
    is gone go too; empty ones that were empty before stay. Rows without a doc_id come last, and
    are cut like others.
    """
    cut = suffix.deduplicate(docs, as_text=True).filter("n_removed = 0 OR n_removed < n_bytes")
    return resized(common.in_order(cut, docs.columns, F.col("kept")), docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret of a text by a mask."""
    return resized(secrets.redact(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row for each piece."""
    return packing.pack(docs, queries.vocabulary())


def resized(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with n_chars as their texts now are, in the columns of docs."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scan", masked_secrets),
    ("best_fit_packing", packed),
]

#: The stages hold trained models, hashes and tokenizers: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again in the shared folder."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
