"""Registered queries and, beside each, the same result in plain SQL."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_folder(spark: SparkSession) -> SparkSession:
    """Gives a local session that names no shared folder one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="workload-"))
    return spark


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)``; without ``sql`` only rows are checked."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(with_folder(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
