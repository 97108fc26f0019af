"""A store of a model's answers, addressed by what was asked.

A question's id is the hash of its texts, so an answer holds for every notebook, run and
night that asks the same.  The store is a folder:

    answers/slice=<id>/   answers of one slice (request_id, content, error)
    manifest/             one row for each slice that is complete

New questions are found by an anti-join on ids.  They are scored in slices; a slice is one
job whose files count from the moment its row stands in the manifest.  A run that dies
leaves all complete slices; the next one asks only what they lack.  Within a slice a lost
task asks again what was its own part: ``per_task`` questions at most, or, in a run of more
than ``MOST_SLICES`` such slices, its share of so many larger ones.

One run writes to a store at a time.  Answers that are errors are kept; ``retry_errors``
asks those questions again, and a later answer takes the place of an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shared

SCHEMA = "request_id string, content string, error string"
MANIFEST = "slice string, run string, number int, questions long, at timestamp"
#: Questions of one task, and tasks at once, unless told otherwise.
PER_TASK, PARALLELISM = 256, 32
#: Slices of one run.  Each costs three short jobs, whatever it holds; more questions make them larger.
MOST_SLICES = 64
#: Text, in bytes, that one task is given where answers go to no store.
TASK_BYTES = 256 << 20


def dealt(requests: DataFrame, slices: int) -> list[DataFrame]:
    """Stored requests in ``slices`` parts, told apart by the hash of the id: repeatable, and even whatever the texts are."""
    if slices <= 1:
        return [requests] * slices
    number = F.pmod(F.xxhash64("request_id"), F.lit(slices)).cast("int")
    rows = shared.stored(requests.withColumn("number", number), "slices", by="number")
    return [rows.filter(F.col("number") == k).select(*requests.columns) for k in range(slices)]


def answered_by(answer: Callable[[str, str], str]) -> Callable[[Iterator], Iterator]:
    """Batches of requests to batches of responses; an exception becomes the row's error."""

    def answered(batches: Iterator) -> Iterator:
        import pandas as pd

        def ask(system: str, user: str) -> tuple[str | None, str | None]:
            try:
                return answer(system, user), None
            except Exception as e:  # noqa: BLE001 - any failure is data here
                return None, str(e)

        for batch in batches:
            pairs = [ask(s, u) for s, u in zip(batch["system"], batch["user"])]
            yield pd.DataFrame(
                {"request_id": batch["request_id"], "content": [c for c, _ in pairs], "error": [e for _, e in pairs]},
                dtype=object,
            )

    return answered


class ResponseStore:
    """The answers in a folder that all machines reach; made when something is first written."""

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location = spark, location.rstrip("/")

    # ---- reading ---------------------------------------------------------------------
    def slices(self) -> DataFrame:
        """The manifest: one row for each complete slice."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.location}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def rows(self) -> DataFrame:
        """Everything that complete slices hold, with the slice and when it was completed."""
        # one row per slice: some for each run
        complete = self.slices().select("slice", "at").collect()
        if not complete:
            return self.spark.createDataFrame([], f"{SCHEMA}, slice string, at timestamp")
        paths = [f"{self.location}/answers/slice={row['slice']}" for row in complete]
        found = self.spark.read.schema(f"{SCHEMA}, slice string").option("basePath", f"{self.location}/answers").parquet(*paths)
        return found.join(self.slices().select("slice", "at"), "slice")

    def answers(self) -> DataFrame:
        """One response per question: an answer before an error, the newest of several."""
        best = F.max_by(F.struct("content", "error"), F.struct(F.col("error").isNull(), "at", "slice"))
        return self.rows().groupBy("request_id").agg(best.alias("best")).select("request_id", "best.*")

    def known(self, retry_errors: bool = False) -> DataFrame:
        """Ids of questions that needn't be asked."""
        rows = self.rows()
        return (rows.filter(F.col("error").isNull()) if retry_errors else rows).select("request_id")

    # ---- writing ---------------------------------------------------------------------
    def _commit(self, name: str, run: str, number: int, questions: int) -> None:
        row = self.spark.range(1).select(
            F.lit(name).alias("slice"), F.lit(run).alias("run"), F.lit(number).cast("int").alias("number"),
            F.lit(questions).cast("long").alias("questions"), F.current_timestamp().alias("at"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.location}/manifest")

    def score(
        self,
        requests: DataFrame,
        answer: Callable[[str, str], str],
        parallelism: int = PARALLELISM,
        *,
        per_task: int = PER_TASK,
        run: str = "",
        retry_errors: bool = False,
    ) -> DataFrame:
        """Asks what the store can't answer yet, and returns all its answers.

        ``requests``: ``(request_id, system, user)``, each question once.  They are put
        into slices of ``parallelism`` tasks, ``MOST_SLICES`` at most, and stored, then
        scored slice by slice.
        """
        pending = requests.join(self.known(retry_errors), "request_id", "left_anti")
        pending = shared.stored(pending.select("request_id", "system", "user"), "pending")
        total = pending.count()
        slices = min(-(-total // (parallelism * per_task)), MOST_SLICES)
        for k, part in enumerate(dealt(pending, slices)):
            name = uuid.uuid4().hex
            scored = part.repartition(parallelism, "request_id").mapInPandas(answered_by(answer), SCHEMA)
            target = f"{self.location}/answers/slice={name}"
            scored.write.parquet(target)
            self._commit(name, run, k, self.spark.read.schema(SCHEMA).parquet(target).count())
        return self.answers()

    def compact(self, files: int = 1) -> None:
        """Puts all answers into one slice and names it alone in the manifest.

        Older slices stay on disk until their folders are removed by hand: a run that
        reads them goes on undisturbed.
        """
        name = uuid.uuid4().hex
        target = f"{self.location}/answers/slice={name}"
        self.answers().repartition(files, "request_id").write.parquet(target)
        row = self.spark.read.schema(SCHEMA).parquet(target).agg(
            F.lit(name).alias("slice"), F.lit("compact").alias("run"), F.lit(0).alias("number"),
            F.count(F.lit(1)).alias("questions"), F.current_timestamp().alias("at"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.location}/manifest")
