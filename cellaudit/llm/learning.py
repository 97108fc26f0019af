"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash values that decide about sampling lie below this.
_SPAN = 1 << 52


def chosen(rows: DataFrame, key: str, label: str, per_label: int) -> Column:
    """Condition that about ``per_label`` rows of each label meet, all if there are fewer.

    One pass counts the labels; a row is taken if the hash of its key lies below its
    label's share.  The choice depends on the rows alone, not on their order.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    place = F.xxhash64(F.col(key)).bitwiseAND(F.lit(_SPAN - 1))
    limit = F.lit(0)
    for value, n in sorted(counts.items(), key=str):
        if value is not None:
            limit = F.when(F.col(label) == F.lit(value), F.lit(int(_SPAN * min(1.0, per_label / n)))).otherwise(limit)
    return place < limit


def sampled(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """The rows that ``chosen`` takes."""
    return rows.where(chosen(rows, key, label, per_label))


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, learnable, per_label: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of the labelled documents that may be learned from.

    The sample of labels is bounded, so it is sent to all executors and the texts stay
    where they are.
    """
    rows = labels.select("doc_id", F.col(target).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    few = sampled(rows.where(learnable(F.col("doc_id"))), "doc_id", "label", per_label)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id")
