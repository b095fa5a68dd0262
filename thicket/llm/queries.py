"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import exact_dedup, html_blocks, lm_scoring, mixing, prob_minhash, quality_knn, quality_rules, sentencepiece_scan, suffix_dedup, toxicity
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.digest(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "host_docs", "host_failed")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return lm_scoring.score(table(spark, sf_dir, "documents"), good)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.weigh(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")))
    p = [F.col("posterior")[d].alias(f"p_{d}") for d in ("clean", "low", "toxic")]
    return out.select("doc_id", "n_words", *p, "rate", "copies")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.decide(table(spark, sf_dir, "documents"))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_exact_dedup, op3_quality_rules, op4_html_blocks, op5_lm_scoring, op6_mixing, op7_suffix_dedup, op8_prob_minhash, op9_quality_knn, op10_toxicity)
}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {"op2_exact_dedup": exact_dedup.ORACLE, "op3_quality_rules": quality_rules.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
