"""Tables written once into the cluster's shared folder.

A result that several later jobs read, or that was expensive or not repeatable
to compute, is written as a table in ``spark.checkpoint.dir``.  Reading it back
cuts the lineage, survives lost executors, and gives the optimizer true sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def new_location(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back.

    ``by``: a column of few values; rows of one value are files of their own, so
    that reading one value reads nothing else.
    """
    location = new_location(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)
