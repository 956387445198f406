"""The registered queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_extract, jaccard_join, mixing, packing, quality, secret_scan, suffix_dedup, topk, warc
from .common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, sf_dir)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_warc": op2_warc,
    "op3_html_extract": op3_html_extract,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_topk": op8_exact_topk,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": mixing.report_sql(),
    "op8_exact_topk": topk.report_sql(),
}
