"""A corpus pipeline over `documents`: toxicity, exact and near duplicates, mixing to target weights, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All stages but the last return the columns of `documents`.

Nulls count as empty texts and stay until an equal text goes before them; of rows that repeat one stays.  Without labels
of both classes nothing is toxic, and without any there is one domain, so nothing is thinned.  Empty tables pass through,
and further columns of `documents` are kept, whatever their names.  Ties are as the operators state them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import exact_dedup, mixing, prob_minhash, sentencepiece_scan, toxicity
from thicket.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return prob_minhash.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixing rates say: clean ones stay, those of low quality are thinned.  Toxic documents
    are gone by now; the few labelled ones that are left would make a domain that can't be told from clean text."""
    labels = table(spark, sf_dir, "labels").where(F.coalesce("toxic", F.lit(0)) == 0)
    return mixing.mix(docs, mixing.label_domains(labels))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc and the digest of the text decoded again."""
    return sentencepiece_scan.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can't express compression, sketches, descent and segmentation.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
