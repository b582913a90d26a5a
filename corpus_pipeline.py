"""The corpus pipeline: five stages over documents, each written and read again by its caller.

Defined cases, beyond those of each operator: a document without letters (a null
or empty text too) leaves in the first stage; lang then holds the predicted
language; a repeated doc_id keeps one row after the third stage; a document may
come up to three times out of the fourth, and each time is packed on its own; an
empty table stays empty with its columns; further columns are carried along by
all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latentspark.llm import language_id, line_rules, mixing, packing, simhash
from latentspark.llm.common import load

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; lang becomes the predicted one. Profiles are learned from these docs."""
    return language_id.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines frequent in a host, then documents that fail the base rules or are depleted."""
    return line_rules.clean_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each SimHash component."""
    return simhash.keep_one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the capped mix takes it."""
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row into sequences; rows that repeat a document are packed as often."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing, SimHash and trained language profiles have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
