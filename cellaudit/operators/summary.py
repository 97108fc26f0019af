"""Counting findings.

Every count is an aggregate with a partial step before the shuffle, so one rule
or one notebook holding a large share of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _is(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def _counts() -> list[Column]:
    return [
        _is(fixed.PASSED).alias("passed"),
        _is(fixed.FAILED).alias("failed"),
        _is(fixed.PENDING).alias("pending"),
    ]


def pass_rate(total: Column, passed: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(passed / total)


# ---- AGG1 ------------------------------------------------------------------------
def summary_total(findings: DataFrame) -> DataFrame:
    counted = findings.agg(F.count(F.lit(1)).alias("total_results"), *_counts())
    return counted.withColumnsRenamed(
        {"passed": "passed_results", "failed": "failed_results", "pending": "pending_results"}
    ).withColumn("pass_rate", pass_rate(F.col("total_results"), F.col("passed_results")))


# ---- AGG2, AGG3 ------------------------------------------------------------------
def summary_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(*_counts())


def summary_by_notebook(findings: DataFrame) -> DataFrame:
    return findings.groupBy("notebook_path").agg(*_counts())


# ---- AGG4 ------------------------------------------------------------------------
def summary_cube(findings: DataFrame) -> DataFrame:
    """The three summaries as one table; ``level`` tells which one a row is of."""
    narrow = findings.select("rule", "notebook_path", "status")
    rule, notebook = F.col("rule"), F.col("notebook_path")
    cube = narrow.groupingSets([[], [rule], [notebook]], rule, notebook).agg(F.grouping_id().alias("gid"), *_counts())
    level = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "rule").otherwise("notebook")
    return cube.select(level.alias("level"), "rule", "notebook_path", "passed", "failed", "pending")


# ---- AGG5 ------------------------------------------------------------------------
def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(fixed.SEVERITIES))
    for i, name in enumerate(fixed.SEVERITIES):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def summary_by_severity_category(findings: DataFrame) -> DataFrame:
    """Counts by severity and domain with subtotals, worst severity first."""
    rolled = findings.rollup("severity", "domain").agg(F.grouping_id().alias("level"), *_counts())
    order = [F.col("level").desc(), severity_rank(F.col("severity")), F.col("domain")]
    return rolled.orderBy(*order)


# ---- AGG6 ------------------------------------------------------------------------
def batch_run_summary(findings: DataFrame) -> DataFrame:
    """Notebooks in the run, how many could be read, and all passes and failures.

    First one row per notebook, then the total: no distinct count over all rows.
    """
    per_notebook = findings.groupBy("notebook_path").agg(
        F.bool_or(F.col("rule") == fixed.ACCESS_LABEL).alias("unreadable"),
        _is(fixed.PASSED).alias("passed"),
        _is(fixed.FAILED).alias("failed"),
    )
    return per_notebook.agg(
        F.count(F.lit(1)).alias("total_notebooks"),
        F.count_if(~F.col("unreadable")).alias("successful_validations"),
        F.count_if(F.col("unreadable")).alias("failed_validations"),
        F.coalesce(F.sum("passed"), F.lit(0)).alias("total_passed"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("total_failed"),
    )


# ---- AGG7 ------------------------------------------------------------------------
def quality_gate(findings: DataFrame, by: list[str], severity_floor: str | None = None) -> DataFrame:
    """Per run or pull request: closed if anything failed (at or above a severity)."""
    counts = F.col("status") == fixed.FAILED
    if severity_floor is not None:
        counts = counts & (severity_rank(F.col("severity")) <= fixed.SEVERITIES.index(severity_floor))
    gate = findings.groupBy(*by).agg(F.count_if(counts).alias("blocking"))
    return gate.withColumn("gate_open", F.col("blocking") == 0).withColumn(
        "exit_code", F.when(F.col("blocking") == 0, 0).otherwise(1)
    )
