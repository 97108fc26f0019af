"""The training-data pipeline: five stages over ``documents``, each a numbered operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet to the shared folder and read back as the next one's documents.  All stages but
the last return the columns that they were given, whatever their names.  Empty tables
pass through; what the stages make of nulls, ties and repeated rows is written in their
operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellaudit.llm import minhash, packing, quality_cnn, quality_rules, secret_scan
from cellaudit.llm.tables import stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source."""
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good; it learns from the documents before any filter."""
    return quality_cnn.kept_documents(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: words in shingles of five."""
    return minhash.without_near_duplicates(docs, words=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets masked."""
    return secret_scan.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: the pieces of all documents with their ids."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: The classifier learns, which SQL cannot state; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        df = stored(stage(spark, df, sf_dir), name)
    return df
