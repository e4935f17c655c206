"""A training corpus from raw documents: toxicity, language ID, near-duplicates, mixing and packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelab.llm import langid, mixing, packing, simhash, toxicity
from tracelab.llm.common import shared_path, table

#: A document whose language is less likely than this is rejected.
LEAST_LANGUAGE = 0.35


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier marks as toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those in no language that was learnt."""
    return langid.reject(docs, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream of docs: a document stands in it as often as it is used, with the columns of documents."""
    return mixing.mixed_documents(docs, max_repeats=1.05)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("language_id", unknown_languages),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", sequence_packing),
]

#: Trained classifiers and 64-bit XXH hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again as the next one's input.

    A null text counts as empty: it has no letter, so language ID rejects it. Rows without ids and repeated rows are rows of
    their own until the near-duplicate stage keeps one of each group of like texts; null langs and sources are values like
    others (no label is learnt from a null lang). Further columns pass through all stages but the last. Empty tables pass
    through every stage: without labels nothing is toxic, without languages every document is rejected.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
