"""The corpus pipeline: stages over documents, each stored and read again as the next one's input.

Defined results of all stages but the last: rows keep all their columns, whatever their names; what goes is decided by row, that is by identifier
and text, so that rows without an identifier, and rows that share one, are judged by their own text; null texts count as empty
ones and stay null where they stay; a table without rows gives none. Each stage says below what it makes of repeated rows and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seclake.llm import decontamination, exact_dedup, packing, simhash_dedup, toxicity
from seclake.plans.workspace import written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find toxic; it learns from the labels of the documents given.

    Repeated rows go or stay together, and a score of exactly one half is toxic. Without labels nothing is.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest identifier of each group of equal texts.

    One row stays of each group: one without an identifier only where no other has one, and of rows that share the largest identifier one.
    """
    return exact_dedup.without_copies(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each group of near copies.

    One row stays of each group, as above. Texts without words are near copies of each other.
    """
    return simhash_dedup.one_of_each(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Repeated rows go or stay together; items without words are held by none."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences. Every row is packed, repeated ones too; one without text is a piece of the end id."""
    return packing.packed(docs)


STAGES = [("toxicity", clean), ("exact dedup", unique), ("SimHash near-dedup", distinct), ("benchmark decontamination", unleaked), ("best-fit packing", pack)]
#: A trained classifier and a packing plan are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
