"""A training-data pipeline in four stages, each over all that its predecessor kept.

Defined cases, for every stage: an empty table gives an empty result; texts of any length are read whole; columns of any name are kept by all
stages but the last. What a stage does with nulls, empty texts, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import common, dedup, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go: all without text too, as they have under ten words. Repeated rows
    share their fate; a null id counts for nothing; without labels the base rule alone decides."""
    return quality.accepted(docs, quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the least id (of equal ids the least text hash; null ids last); of repeated rows one. Texts
    that are null, empty or blank are one group."""
    return dedup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes its kind in angle brackets; a changed text's n_chars follows. A null text stays null; every row stays, repeated
    ones too."""
    return pii.masked(docs, n_chars="n_chars")


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document, with its place. A null or empty text is one piece, its end token; repeated rows and
    null ids are packed each for itself."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", best_fit),
]

#: SQL can't express the learned list, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and reread as the next stage's input, and goes when that stage is written."""
    docs = common.documents(spark, sf_dir)
    folder = common.shared_dir(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = common.keep(stage(spark, docs, sf_dir), folder, f"stage_{number}")
        if number:
            common.discard(spark, f"{folder}/stage_{number - 1}")
    return docs
