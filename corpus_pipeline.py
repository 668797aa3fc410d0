"""From raw documents to packed training sequences, each stage by one corpus operator.

Every stage but the last gives rows with the columns of ``documents``; each is written as
Parquet and read again before the next, so a stage always works on a stored table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import exact, langid, mixing, near, packing
from strata.llm.tables import read, small_batches
from strata.session import save

# Near duplicates of the corpus share 80 percent of their five-word shingles; op5 asks for 85.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) or with an unsure one go."""
    small_batches(spark)
    return langid.identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts stays."""
    small_batches(spark)
    return exact.without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays."""
    small_batches(spark)
    return near.without_near_duplicates(docs, percent=NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: a document comes as often as the mix takes it."""
    small_batches(spark)
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mixture),
    ("best_fit_packing", sequences),
]

# Neither the classifier nor the mix nor the packing can be said in SQL; tests/llm compares
# the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, one after the other."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
