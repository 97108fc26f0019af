"""Runs registered queries in Spark and in DuckDB and compares them row by row.

    python -m workload.check [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import collections
import datetime
import decimal
import os
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from . import ORACLES, QUERIES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def local_spark(cores: str = "8", folder: str | None = None) -> SparkSession:
    """A local session; ``folder`` stands in for the cluster's shared folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # Call sites of columns are not recorded; plans of many columns build faster.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    return (builder.config("spark.checkpoint.dir", folder) if folder else builder).getOrCreate()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        location = f"{sf_dir}/{name}.parquet"
        if os.path.exists(location):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{location}'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _counted(names: list[str], rows) -> collections.Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if equal, else what differs."""
    result = connection.execute(sql)
    expected_names = [c[0] for c in result.description]
    expected = _counted(expected_names, result.fetchall())
    if sorted(df.columns) != sorted(expected_names):
        return f"columns {sorted(df.columns)} != {sorted(expected_names)}"
    actual = _counted(df.columns, df.collect())
    if actual == expected:
        return ""
    extra, missing = actual - expected, expected - actual
    return f"{sum(actual.values())} vs {sum(expected.values())} rows; only Spark {str(list(extra)[:2])[:600]}; only SQL {str(list(missing)[:2])[:600]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = local_spark()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(args.sf)
    wanted = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            problem = compare(df, connection, ORACLES[name]) if name in ORACLES else ""
            problem = problem or ("" if df.limit(1).count() else "no rows")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4s} {name:36s} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
