"""Audits and trends kept current by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..functions.days import utc_day
from ..operators.catalog import DEFAULT_CATALOG, Setting
from ..operators.engine import validate
from ..operators.rules.base import Rule
from ..sources.findings import keep_schema, of_run


# ---- STR1 ------------------------------------------------------------------------
RUNS = "validation_run_id string, validation_timestamp timestamp, done boolean"


def scheduled_audit(
    arriving: DataFrame,
    location: str,
    checkpoint: str,
    catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG),
    run_id: str = "",
    *,
    extra: Sequence[Rule] = (),
    run_source: str = "schedule",
    redact: bool = True,
) -> StreamingQuery:
    """Audits the notebooks that arrived since the last run, then stops.

    ``arriving`` streams ``(path, content)``; the checkpoint remembers what was read.
    Every batch is a run of its own, ``run_id`` (or ``run_source``) and the batch's
    number, with one time.  What is written is a history, partitioned by day and run,
    found secrets masked.  A batch that is delivered again after a failure has the run
    id and time of its first attempt and replaces what that had written, so it adds
    nothing; finding ids are the same, too.
    """

    def audit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = f"{run_id or run_source}-{number}"
        begun = _begun(spark, location, run)
        if begun["done"]:
            return
        stamp = F.timestamp_micros(F.lit(begun["micros"]))
        found = of_run(validate(batch, catalog, extra=extra, run_id=run), run, run_source, stamp, redact=redact)
        writer = found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "validation_run_id")
        writer.parquet(location)
        keep_schema(found, location)
        _note(spark, location, run, stamp, True)

    writer = arriving.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def runs_of(spark: SparkSession, location: str) -> DataFrame:
    """Runs of the scheduled audit that were begun or done, beside its history."""
    try:
        return spark.read.schema(RUNS).parquet(f"{location.rstrip('/')}.runs")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RUNS)


def _note(spark: SparkSession, location: str, run: str, stamp: Column, done: bool) -> None:
    row = spark.range(1).select(F.lit(run).alias("validation_run_id"), stamp.alias("validation_timestamp"), F.lit(done).alias("done"))
    row.coalesce(1).write.mode("append").parquet(f"{location.rstrip('/')}.runs")


def _begun(spark: SparkSession, location: str, run: str) -> Row:
    """The time of the run's first attempt, and whether it is done; notes a first attempt."""

    def known() -> Row:
        same = runs_of(spark, location).filter(F.col("validation_run_id") == run)
        return same.agg(F.min(F.unix_micros("validation_timestamp")).alias("micros"), F.coalesce(F.bool_or("done"), F.lit(False)).alias("done")).first()

    if known()["micros"] is None:
        _note(spark, location, run, F.current_timestamp(), False)
    return known()


# ---- STR2 ------------------------------------------------------------------------
def streaming_trend(history: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily totals and passes of arriving findings; days are those of UTC.

    A finding delivered twice counts once; one later than ``delay`` behind the
    newest is dropped.  State is one row per open day and the ids of ``delay``.
    """
    once = history.withWatermark("validation_timestamp", delay).dropDuplicatesWithinWatermark(["audit_id"])
    daily = once.groupBy(F.window("validation_timestamp", "1 day")).agg(
        F.count(F.lit(1)).alias("total_validations"), F.count_if(F.col("status") == fixed.PASSED).alias("passed")
    )
    # Windows start at midnight UTC; the date is named as it is there, in any session time zone.
    return daily.select(utc_day(F.col("window.start")).alias("date"), "total_validations", "passed")


def run_trend(
    history: DataFrame, location: str, checkpoint: str, delay: str = "1 day", prepare: Callable[[DataFrame], DataFrame] = lambda df: df
) -> StreamingQuery:
    """Writes days to ``location`` as they close (end of day is behind the watermark)."""
    closed = streaming_trend(prepare(history), delay)
    writer = closed.writeStream.format("parquet").option("path", location).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
