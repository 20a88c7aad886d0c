"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, lexical, licenses, lm, ordermin, packing, pages, quality, secrets, simhash, suffix, toxicity
from .common import documents, labels

#: The vocabulary file; a name of the public tokenizers' package.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(secrets.scan(documents(spark, sf_dir)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(simhash.classes(documents(spark, sf_dir)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(documents(spark, sf_dir), vocabulary()))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.query(suffix.deduplicate(documents(spark, sf_dir).select("doc_id", "text")))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.query(ordermin.fingerprints(documents(spark, sf_dir)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_secret_scan,
        op3_simhash_near_dedup,
        op4_toxicity,
        op5_bpe_round_trip,
        op6_lm_scoring,
        op7_suffix_array_dedup,
        op8_document_fingerprints,
        op9_quality_rules,
        op10_license_scan,
        op11_phrase_collocations,
        op12_html_extraction,
        op13_lexical_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": secrets.oracle_sql(),
    "op11_phrase_collocations": collocations.oracle_sql(),
    "op13_lexical_search": lexical.oracle_sql(),
}
