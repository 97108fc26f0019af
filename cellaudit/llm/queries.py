"""The registered queries of the numbered operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, hard_negatives, id_files, language_id, minhash, packing, pieces, quality_cnn, quality_rules, secret_scan, toxicity, url_rank, whitening
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_query("op8_quality_rules", quality_rules.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


@_query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed(table(spark, sf_dir, "documents")))


@_query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


@_query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.scored(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


@_query("op10_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(table(spark, sf_dir, "documents"))


@_query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


@_query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identified(docs, language_id.train(docs))


@_query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_query("op6_embedding_dedup", embedding_dedup.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"))


@_query("op9_url_filter", url_rank.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rank.judged(table(spark, sf_dir, "pages"), url_rank.rule_table(spark))


@_query("op11_id_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.round_trip(table(spark, sf_dir, "documents"))


@_query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@_query("op13_hard_negatives", hard_negatives.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))
