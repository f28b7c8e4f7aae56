"""Training-corpus pipeline: toxicity, exact dedup, near dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadlens.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from loadlens.llm.common import staged, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic. Null and empty texts stay; edge cases as in ``toxicity.drop_toxic``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, null and empty ones together; edge cases as in ``exact_dedup.dedup``."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 80 % alike; edge cases as in ``near_dedup.drop_near_duplicates``."""
    return near_dedup.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak none; edge cases as in ``decontaminate.drop_contaminated``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, none of a null or empty text; edge cases as in ``mixing.mix``."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", clean), ("mixing", mixed)]

#: Dictionaries and min-wise hashes are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
