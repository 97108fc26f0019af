"""Findings as tables and files: writing them, and reading the history back."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, shared
from ..functions.days import utc_day

FIELDS = ["rule", "status", "details", "notebook_path", "audit_time", "audit_id"]
MASK = "***"


def redact_secrets(findings: DataFrame, shown: int = 0) -> DataFrame:
    """Masks found secrets in the details, the whole match or all but its first ``shown`` characters."""
    return findings.withColumn("details", masked(F.col("details"), F.col("rule") == fixed.LABEL_SECRETS, shown))


def masked(details: Column, from_secrets: Column, shown: int = 0) -> Column:
    """Details that are fit to be stored."""
    hit = from_secrets & F.startswith(details, F.lit(fixed.SECRET_FOUND))
    return F.when(hit, F.concat(F.left(details, F.lit(len(fixed.SECRET_FOUND) + shown)), F.lit(MASK))).otherwise(details)


def _stored_form(findings: DataFrame | None, redact: bool, shown: int = 0) -> DataFrame:
    if findings is None:
        raise ValueError("no findings to write")
    return redact_secrets(findings, shown) if redact else findings


# ---- SNK2 ------------------------------------------------------------------------
def write_table(
    findings: DataFrame | None,
    name: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    path: str | None = None,
    redact: bool = True,
    shown: int = 0,
) -> None:
    """Any format the session can write; found secrets are masked unless told otherwise.

    ``shown``: how many first characters of a found secret stay, to tell kinds apart.
    """
    writer = _stored_form(findings, redact, shown).write.format(fmt).mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


# ---- SNK3 ------------------------------------------------------------------------
def of_run(
    findings: DataFrame, run_id: str, run_source: str, timestamp: Column | None = None, redact: bool = True
) -> DataFrame:
    """Findings as a history holds them: with the columns of their run, secrets masked."""
    run = _stored_form(findings, redact).withColumns(
        {
            "validation_timestamp": F.current_timestamp() if timestamp is None else timestamp,
            "validation_run_id": F.lit(run_id),
            "validation_source": F.lit(run_source),
        }
    )
    return run.withColumn("run_date", utc_day(F.col("validation_timestamp")))


def append_history(
    findings: DataFrame,
    location: str,
    run_id: str,
    run_source: str,
    timestamp: Column | None = None,
    redact: bool = True,
    audited: DataFrame | None = None,
) -> None:
    """Appends a run to the history, partitioned by date.

    ``timestamp`` defaults to now.  Rows are rebalanced by day: a day's files grow with
    its rows, not with the number of tasks, and a large day is still written by many.
    Beside the history stands its schema, so that no reader opens every file for it.

    ``audited``: paths that the run looked at; they are kept as the run's roster, for
    rules that give rows only where they fail.
    """
    run = of_run(findings, run_id, run_source, timestamp, redact)
    run.hint("rebalance", "run_date").write.mode("append").partitionBy("run_date").parquet(location)
    keep_schema(run, location)
    if audited is not None:
        rows = of_run(audited.select(F.col("path").alias("notebook_path")).distinct(), run_id, run_source, timestamp, redact=False)
        rows.hint("rebalance", "run_date").write.mode("append").partitionBy("run_date").parquet(_beside(location, "roster"))


def _beside(location: str, what: str) -> str:
    return f"{location.rstrip('/')}.{what}"


def keep_schema(run: DataFrame, location: str) -> None:
    """Notes columns that the history did not have before; a line per change."""
    known = _kept_schema(run.sparkSession, location)
    have = {field.name: field.dataType for field in known.fields} if known else {}
    for field in run.schema.fields:
        if field.name in have and have[field.name] != field.dataType:
            raise ValueError(f"column {field.name} of the history is {have[field.name].simpleString()}, not {field.dataType.simpleString()}")
    new = [field for field in run.schema.fields if field.name not in have]
    if new:
        line = run.sparkSession.range(1).select(F.lit(T.StructType(new).json()).alias("value"))
        line.coalesce(1).write.mode("append").text(_beside(location, "schema"))


def _kept_schema(spark: SparkSession, location: str) -> T.StructType | None:
    try:
        lines = spark.read.text(_beside(location, "schema")).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    fields: dict[str, T.StructField] = {}
    for line in lines:
        for field in T.StructType.fromJson(json.loads(line["value"])).fields:
            fields.setdefault(field.name, T.StructField(field.name, field.dataType, True))
    return T.StructType(list(fields.values()))


# ---- SRC7 ------------------------------------------------------------------------
def load_findings(spark: SparkSession, location: str) -> DataFrame:
    """The history; columns that only some runs have are null in the others.

    The schema is read from beside the history; only one that was written without it is
    put together from the files.
    """
    schema = _kept_schema(spark, location)
    if schema is None:
        return spark.read.option("mergeSchema", True).parquet(location)
    return spark.read.schema(schema).parquet(location)


def load_roster(spark: SparkSession, location: str) -> DataFrame:
    """``(notebook_path, validation_run_id, validation_timestamp, ...)`` that runs looked at."""
    return spark.read.parquet(_beside(location, "roster"))


def compact_history(spark: SparkSession, location: str, most_files: int = 1) -> list[str]:
    """Rewrites days that lie in more than ``most_files`` files and returns them.

    The rows of those days are first stored elsewhere; then only these days are
    replaced.  Files of a day hold rebalanced rows, so a large day keeps several.
    """
    history = load_findings(spark, location)
    files = history.groupBy("run_date").agg(F.count_distinct("_metadata.file_path").alias("files"))
    days = [row["run_date"] for row in files.filter(F.col("files") > most_files).select("run_date").collect()]
    if not days:
        return []
    rows = shared.stored(history.filter(F.col("run_date").isin(days)), "compacted")
    writer = rows.hint("rebalance", "run_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_date").parquet(location)
    return sorted(str(day) for day in days)


# ---- SNK4, SNK5 ------------------------------------------------------------------
def write_json(findings: DataFrame, location: str, redact: bool = True) -> None:
    """One JSON object per line, null fields included."""
    _stored_form(findings.select(*FIELDS), redact).write.option("ignoreNullFields", False).json(location)


def write_csv(findings: DataFrame, location: str, redact: bool = True, shown: int = 0) -> None:
    """Header and rows; details may hold quotes and line breaks.  ``shown`` as in ``write_table``."""
    _stored_form(findings.select(*FIELDS), redact, shown).write.option("header", True).option("escape", '"').csv(location)


# ---- SNK6 ------------------------------------------------------------------------
def _escaped(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def html_rows(findings: DataFrame) -> DataFrame:
    """HTML fragments ``(notebook_path, part, rule, seq, html)``: per notebook one
    heading with its counts, then one table row per finding.

    Fragments stay rows, so a notebook with very many findings is never one value.
    """
    counts = findings.groupBy("notebook_path").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in fixed.STATUSES]
    )
    numbers = [F.concat(F.lit(f'</p><p class="{s.lower()}">{s}: '), F.col(s.lower()).cast("string")) for s in fixed.STATUSES]
    heading = F.concat(
        F.lit("<h2>"), _escaped(F.col("notebook_path")), F.lit("</h2><p>Total validations: "), F.col("total").cast("string"), *numbers, F.lit("</p>")
    )
    cells = F.concat(
        F.lit("<tr><td>"), _escaped(F.col("notebook_path")), F.lit("</td><td>"), _escaped(F.col("rule")),
        F.lit('</td><td class="'), F.lower("status"), F.lit('">'), F.col("status"), F.lit("</td><td>"), _escaped(F.col("details")), F.lit("</td></tr>"),
    )
    heads = counts.select("notebook_path", F.lit("head").alias("part"), F.lit("").alias("rule"), F.lit(0).alias("seq"), heading.alias("html"))
    rows = findings.select("notebook_path", F.lit("row").alias("part"), "rule", F.col("seq").cast("int").alias("seq"), cells.alias("html"))
    return heads.unionByName(rows)


def write_html(findings: DataFrame, location: str, redact: bool = True) -> None:
    """The fragments as text, notebook after notebook; a big notebook spans files."""
    order = ["notebook_path", "part", "rule", "seq"]
    # range by more than the path: one notebook with very many rows is split as well
    fragments = html_rows(_stored_form(findings, redact)).repartitionByRange(*order)
    fragments.sortWithinPartitions(*order).select(F.replace("html", F.lit("\n"), F.lit("<br>")).alias("value")).write.text(location)
