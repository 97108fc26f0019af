"""Reports over the accumulated findings.

All take a history table (findings plus run columns) and return a DataFrame.
Dates come in as parameters, never from the clock, so a report can be repeated.
Filters on ``run_date`` reach the partitions of the stored history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.days import utc_day
from ..functions.rows import repeated
from ..operators.catalog import attach_severity

DAYS = 30
#: What a failure has in common with itself in another run.
SAME_FAILURE = ("notebook_path", "rule", "details")


def _recent(history: DataFrame, as_of: str, days: int) -> DataFrame:
    """The findings of the day ``as_of`` and so many days before it."""
    last = F.lit(as_of).cast("date")
    recent = history.filter(utc_day(F.col("validation_timestamp")).between(F.date_sub(last, days), last))
    if "run_date" not in history.columns:
        return recent
    # The time decides; the date is there for partition pruning, a day wider for histories dated in another zone.
    return recent.filter(F.col("run_date").between(F.date_sub(last, days + 1), F.date_add(last, 1)))


def _rate(passed: Column, total: Column) -> Column:
    return F.round(F.lit(100).cast("decimal(20,1)") * passed / total, 2).cast("double")


def _success(groups: DataFrame, by: list[Column | str], total: str, passed: str) -> DataFrame:
    counted = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias(total), F.count_if(F.col("status") == fixed.PASSED).alias(passed)
    )
    return counted.withColumn("success_rate", _rate(F.col(passed), F.col(total)))


# ---- RPT1 --------------------------------------------------------------------------
def daily_success_trend(history: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    day = utc_day(F.col("validation_timestamp")).alias("date")
    return _success(_recent(history, as_of, days), [day], "total_validations", "passed").orderBy(F.desc("date"))


# ---- RPT2 --------------------------------------------------------------------------
def pr_success_rate(history: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    rates = _success(_recent(history, as_of, days), ["pr_number", "pr_branch"], "total_validations", "passed_validations")
    return rates.orderBy(F.desc("pr_number"), "pr_branch")


# ---- RPT3 --------------------------------------------------------------------------
def latest_findings(history: DataFrame, n: int = 100) -> DataFrame:
    """The newest n.  Each task keeps its own n, so nothing is sorted as a whole."""
    shown = history.select("notebook_path", "domain", "rule", "status", "validation_timestamp", "audit_id")
    return shown.orderBy(F.desc("validation_timestamp"), "audit_id").limit(n)


# ---- RPT4 --------------------------------------------------------------------------
def pr_detail(history: DataFrame, pr_number: int) -> DataFrame:
    one = history.filter(F.col("pr_number") == pr_number)
    shown = one.select("pr_number", "pr_branch", "notebook_path", "rule", "status", "validation_timestamp", "audit_id")
    return shown.orderBy(F.desc("validation_timestamp"), "audit_id")


# ---- RPT5 --------------------------------------------------------------------------
def failures_by_category(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Failures per domain.  Counted per rule first: what meets the catalog is one row per rule."""
    failed = findings.filter(F.col("status") == fixed.FAILED)
    per_rule = failed.groupBy("rule_key", *[c for c in findings.columns if c == "domain"]).agg(F.count(F.lit(1)).alias("n"))
    return attach_severity(per_rule, catalog).groupBy("domain").agg(F.sum("n").alias("failures"))


# ---- RPT6 --------------------------------------------------------------------------
def top_offenders(findings: DataFrame, k: int) -> DataFrame:
    failed = findings.filter(F.col("status") == fixed.FAILED)
    counted = failed.groupBy("notebook_path").agg(F.count(F.lit(1)).alias("failures"))
    return counted.orderBy(F.desc("failures"), "notebook_path").limit(k)


def top_offenders_by_domain(findings: DataFrame, k: int) -> DataFrame:
    """Up to rank k in every domain, ties included.

    Ranks are found among the different numbers of failures, which are few, and
    joined back; however many notebooks tie, no task gets all of a domain.
    """
    failed = findings.filter(F.col("status") == fixed.FAILED)
    counted = failed.groupBy("domain", "notebook_path").agg(F.count(F.lit(1)).alias("failures"))
    numbers = counted.groupBy("domain", "failures").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("domain").orderBy(F.desc("failures")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = numbers.withColumn("rank", F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).filter(F.col("rank") <= k)
    leading = ranked.select(F.col("domain").alias("in_domain"), F.col("failures").alias("with_failures"), F.col("rank").cast("int").alias("rank"))
    same = F.col("domain").eqNullSafe(F.col("in_domain")) & (F.col("failures") == F.col("with_failures"))
    return counted.join(leading, same).select("domain", "notebook_path", "failures", "rank")


# ---- RPT7 --------------------------------------------------------------------------
TICKET_OPEN, TICKET_CLOSED = "open", "closed"
LEDGER = (
    "ticket_id string, title string, notebook string, domain string, rule_key string, rule string, details string, occurrence int, "
    "state string, opened_run string, closed_run string, reopened int, action string"
)


def open_failures(findings: DataFrame) -> DataFrame:
    """Failures as tickets know them: ``(ticket_id, title, notebook, domain, rule_key, rule, details, occurrence)``.

    The id is made of what a failure is about, not of the run that saw it: domain, rule
    key, notebook, details, and which of several equal failures of the notebook it is.
    Equal failures are counted first, so a notebook with very many is no group.
    """
    names = {"domain": F.lit(""), "rule_key": F.col("rule")}
    about = {name: F.coalesce(F.col(name), default) if name in findings.columns else default for name, default in names.items()}
    failed = findings.filter(F.col("status") == fixed.FAILED).select(
        F.col("notebook_path").alias("notebook"), "rule", "details", *[column.alias(name) for name, column in about.items()]
    )
    keys = ["notebook", "domain", "rule_key", "rule", "details"]
    each = repeated(failed.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")), keys)
    texts = [F.coalesce(name, F.lit("")) for name in ("domain", "rule_key", "notebook", "details")]
    parts = [part for text in texts for part in (F.length(text).cast("string"), text)]
    ticket = F.sha2(F.concat_ws("|", *parts, F.col("details").isNull().cast("string"), F.col("copy").cast("string")), 256)
    title = F.concat(F.lit(fixed.TICKET_TITLE), F.col("rule"))
    return each.select(ticket.alias("ticket_id"), title.alias("title"), *keys, F.col("copy").cast("int").alias("occurrence"))


def ticket_ledger(
    findings: DataFrame, ledger: DataFrame | None = None, run_id: str = "", audited: DataFrame | None = None
) -> DataFrame:
    """The ledger of tickets after a run, with what the run did to each (``action``).

    A failure without ticket opens one, one whose ticket is closed reopens it.  A ticket
    whose failure is gone is closed if its notebook was looked at: ``audited`` (paths),
    by default the notebooks that have findings.  Others stay as they are.
    """
    now = open_failures(findings).withColumn("failing", F.lit(True))
    looked = (findings.select(F.col("notebook_path").alias("path")) if audited is None else audited.select("path")).distinct()
    before = findings.sparkSession.createDataFrame([], LEDGER) if ledger is None else ledger
    old = before.drop("action").withColumnsRenamed({c: f"old_{c}" for c in before.columns})
    joined = now.join(old, F.col("ticket_id") == F.col("old_ticket_id"), "full_outer")
    names = ["ticket_id", "title", "notebook", "domain", "rule_key", "rule", "details", "occurrence"]
    known = joined.select(
        *[F.coalesce(c, f"old_{c}").alias(c) for c in names], "old_state", "old_opened_run", "old_closed_run", "old_reopened",
        F.coalesce("failing", F.lit(False)).alias("failing"),
    )
    seen = known.join(looked.withColumn("seen", F.lit(True)), F.col("notebook") == F.col("path"), "left")
    was, failing = F.col("old_state"), F.col("failing")
    action = (
        F.when(failing & was.isNull(), "opened")
        .when(failing & (was == TICKET_CLOSED), "reopened")
        .when(failing, "still open")
        .when((was == TICKET_OPEN) & F.col("seen").isNotNull(), "closed")
        .otherwise("unchanged")
    )
    acted = seen.withColumn("action", action)
    did = F.col("action")
    return acted.select(
        *names,
        F.when(failing, TICKET_OPEN).when(did == "closed", TICKET_CLOSED).otherwise(was).alias("state"),
        F.when(did == "opened", F.lit(run_id)).otherwise(F.col("old_opened_run")).alias("opened_run"),
        F.when(did == "closed", F.lit(run_id)).when(did == "reopened", F.lit(None)).otherwise(F.col("old_closed_run")).alias("closed_run"),
        (F.coalesce("old_reopened", F.lit(0)) + (did == "reopened").cast("int")).alias("reopened"),
        "action",
    )


def failure_tickets(findings: DataFrame, filed: DataFrame | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """One ticket per failure that none was filed for yet.

    ``filed`` holds tickets as this returns them, or a ledger; a failure of an earlier
    night is known by its ``ticket_id``.  With ``by``, columns of ``findings`` and
    ``filed``, findings are compared by these instead and come with their ``audit_id``.
    """
    if by is None:
        failures = open_failures(findings)
        if filed is not None:
            still = filed.filter(F.col("state") == TICKET_OPEN) if "state" in filed.columns else filed
            failures = failures.join(still.select("ticket_id"), "ticket_id", "left_anti")
        return failures.select("ticket_id", "title", "notebook", "details", "occurrence")
    failed = findings.filter(F.col("status") == fixed.FAILED)
    if filed is not None:
        known = filed.select(*[F.col(name).alias(f"filed_{name}") for name in by])
        same = [F.col(name).eqNullSafe(F.col(f"filed_{name}")) for name in by]
        failed = failed.join(known, reduce(and_, same), "left_anti")
    if tuple(by) != ("audit_id",):
        failed = failed.dropDuplicates(list(by))
    return failed.select(
        F.concat(F.lit(fixed.TICKET_TITLE), F.col("rule")).alias("title"),
        F.col("notebook_path").alias("notebook"),
        "details",
        "audit_id",
    )


# ---- RPT8 --------------------------------------------------------------------------
def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s.lower()) for s in fixed.STATUSES]


def monitoring_payload(findings: DataFrame) -> DataFrame:
    """Summary documents as JSON: one for the run, with its totals and counts per
    rule, and one per notebook.

    Rules are a bounded set and fit one document.  Notebooks are not, so each is
    a document of its own instead of a part of the run's.
    """
    per_rule = findings.groupBy("rule").agg(*_counts())
    counts = [s.lower() for s in fixed.STATUSES]
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in counts}
    total = sum(sums.values(), F.lit(0))
    run = per_rule.agg(
        *[column.alias(f"{c}_results") for c, column in sums.items()],
        total.alias("total_results"),
        F.array_sort(F.collect_list(F.struct("rule", F.struct(*counts).alias("counts")))).alias("rules"),
    )
    summary = F.struct(
        "total_results",
        *[f"{c}_results" for c in counts],
        F.when(F.col("total_results") > 0, F.col("passed_results") / F.col("total_results")).otherwise(0.0).alias("pass_rate"),
        F.map_from_entries("rules").alias("rule_summary"),
    )
    run_document = run.select(F.lit("run").alias("kind"), F.lit("").alias("name"), F.to_json(summary).alias("payload"))
    per_notebook = findings.groupBy("notebook_path").agg(*_counts())
    notebooks = per_notebook.select(
        F.lit("notebook").alias("kind"), F.col("notebook_path").alias("name"), F.to_json(F.struct(*counts)).alias("payload")
    )
    return run_document.unionByName(notebooks)


# ---- RPT9, RPT10 -------------------------------------------------------------------
def combined(tables: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Findings of several tables as one, each row labelled with where it is from."""
    labelled = [table.withColumn(label, F.lit(name)) for name, table in tables.items()]
    result = labelled[0]
    for other in labelled[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def multi_env_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Failures per rule, environments side by side."""
    failed = combined(tables, "env").filter(F.col("status") == fixed.FAILED)
    side_by_side = failed.groupBy("rule").pivot("env", list(tables)).agg(F.count(F.lit(1)))
    return side_by_side.fillna(0, list(tables))


def multi_repo_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _success(combined(tables, "repo"), ["repo"], "total_validations", "passed")


# ---- RPT11 -------------------------------------------------------------------------
def regressions(history: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Rules of a notebook that newly fail or are newly fixed against the run before.

    Runs are told apart by ``validation_run_id`` and follow one another by their
    latest time; a history without ids has one run per ``run_date``.

    Many rules give rows only where they fail.  So every run that looked at a notebook
    says something about each rule that the notebook has ever had rows of: without a
    row, the rule does not fail.  ``roster`` (``notebook_path`` and the columns of its
    run) says what runs looked at; by default that is every notebook they have rows of.
    Runs of a notebook are numbered.  Only failures are compared then: a rule newly fails
    where its failure has none in the run before, and is newly fixed in the run after one
    that has no other.  Failures are first reduced to one row per notebook, rule and run, so
    a window group has at most as many rows as there were runs, however many findings.
    """
    key = ["notebook_path", "rule"]
    named = "validation_run_id" in history.columns
    run, when = ("validation_run_id", "validation_timestamp") if named else ("run_date", "run_date")

    def seen(rows: DataFrame) -> DataFrame:
        return rows.select("notebook_path", F.col(run).alias("run"), F.col(when).alias("at"))

    looked = (seen(history) if roster is None else seen(history).unionByName(seen(roster))).groupBy("notebook_path", "run").agg(F.max("at").alias("at"))
    in_turn = Window.partitionBy("notebook_path").orderBy("at", "run")
    runs = looked.select("*", F.row_number().over(in_turn).alias("n"), F.lead(F.struct("run", "at")).over(in_turn).alias("next"))
    # a rule or run without a name is never compared, as it equals no other
    failures = history.filter((F.col("status") == fixed.FAILED) & F.col("rule").isNotNull()).select(*key, F.col(run).alias("run")).distinct()
    by_rule = Window.partitionBy(*key).orderBy("n")
    compared = failures.join(runs, ["notebook_path", "run"]).select(
        "*", F.lag("n").over(by_rule).eqNullSafe(F.col("n") - 1).alias("failed_before"), F.lead("n").over(by_rule).eqNullSafe(F.col("n") + 1).alias("fails_after")
    )
    changes = F.array_compact(
        F.array(
            F.when((F.col("n") > 1) & ~F.col("failed_before"), F.struct("run", "at", F.lit("newly failing").alias("change"))),
            F.when(F.col("next").isNotNull() & ~F.col("fails_after"), F.struct("next.run", "next.at", F.lit("newly fixed").alias("change"))),
        )
    )
    changed = compared.select(*key, F.explode(changes).alias("c"))
    days = [utc_day(F.col("c.at")).alias("run_date")] if named else []
    return changed.select(*key, F.col("c.run").alias(run), *days, "c.change")
