"""Dropping rows by a computed condition, and repeating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    """``df.filter(condition).select(columns)`` for a condition that is costly.

    The optimizer moves a filter below the projections its columns come from and
    then evaluates them twice: to filter, and again for the result.  Parsing every
    notebook twice is what that means here.  A row generated on condition stays
    where it is.
    """
    row = F.struct(*columns)
    return df.select(F.inline(F.when(condition, F.array(row))))


REPEATS = 1000


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row as often as its ``copies`` says, numbered by ``copy`` from 1.

    Repeats are made in pieces that are spread first, so a row with very many is
    not one task's work.  ``keys`` tell rows apart.
    """
    last = F.floor((F.col("copies") - 1) / REPEATS).cast("int")
    pieces = df.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).repartition(*keys, "piece")
    first = F.col("piece") * REPEATS + 1
    numbers = F.sequence(first, F.least(first + REPEATS - 1, F.col("copies").cast("int")))
    return pieces.withColumn("copy", F.explode(numbers)).drop("copies", "piece")
