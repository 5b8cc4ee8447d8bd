"""The corpus pipeline: language ID, near duplicates, PII, mixing and packing, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import language_id, mixing, ngram_join, packing, pii
from tallyfold.llm.common import read_table, write_table
from tallyfold.llm.queries import QUERY_KEY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or that no language fits, go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of exact and near copies."""
    return ngram_join.keep_one_of_each(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms."""
    return pii.pseudonymise(docs, QUERY_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet the tempered shares of source, language and topic."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, f"pipeline-{name}")
    return docs


#: Language ID is a trained network, which SQL cannot express; the tests hold the run against brute force.
ORACLE_SQL: str | None = None
