"""A training corpus from raw documents: quality, language, near-duplicates, benchmark passages, packing.

Each stage takes what the one before it kept. All but the last return the columns of ``documents`` unchanged; the last one
returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftway.llm import decontam, langid, near_copies, packing, quality
from driftway.llm.common import table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the model is fitted on labelled rows of ``docs``.

    Null and empty texts are scored by the offset of the model alone. An empty input gives an empty result.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``docs`` names; null texts and texts without a letter go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id: Jaccard 0.8 of five-word shingles.

    SimHash links (operator 5) make the first groups, and shingle prefixes find what lies beyond two bits; both are verified.
    """
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in passages of the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 1024 ids."""
    return packing.pack(docs, keep_words=False)


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Trained models and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each one's rows are written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
