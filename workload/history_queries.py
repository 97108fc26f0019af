"""Queries on accumulated findings: summaries, reports, increments, sinks, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellaudit.functions import fixed, shared
from cellaudit.functions.days import utc_day, utc_time
from cellaudit.operators import counts, engine, incremental, summary
from cellaudit.operators.catalog import rule_catalog
from cellaudit.plans import reports
from cellaudit.sources import findings as store
from cellaudit.streaming import jobs

from . import oracle as o
from .fixture import corpus, documents, notebooks_from, table
from .notebook_queries import CATALOG, SHOWN
from .registry import query

AS_OF = "2024-01-31"
RULE_KEYS = {
    "signup": "avoid_select_star",
    "error": "no_hard_coded_secrets",
    "click": "documentation_and_comments",
    "view": "header_section_exists",
    "purchase": "not_in_the_catalog",
}
ENVIRONMENTS = ["dev", "staging", "prod"]


def _case(values: dict[str, str], key: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for name, value in values.items():
        chosen = F.when(key == name, value).otherwise(chosen)
    return chosen


def history_from(events: DataFrame) -> DataFrame:
    """Findings of many runs, one per event: its user is the notebook, its type the rule."""
    user, event = F.col("user_id"), F.col("event_type")
    status = F.when((event == "error") | (F.col("value") < 20), "Failed").when(F.col("value") > 150, "Pending").otherwise("Passed")
    return events.select(
        event.alias("rule"),
        status.alias("status"),
        F.col("props").alias("details"),
        F.concat(F.lit("/Users/u"), user.cast("string")).alias("notebook_path"),
        F.col("ts").alias("audit_time"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("audit_id"),
        _case(RULE_KEYS, event).alias("rule_key"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("validation_timestamp"),
        utc_day(F.col("ts")).alias("run_date"),
        (user % 40).cast("int").alias("pr_number"),
        F.concat(F.lit("feature/"), (user % 40).cast("string")).alias("pr_branch"),
        F.element_at(F.array(*[F.lit(e) for e in ENVIRONMENTS]), (user % 3).cast("int") + 1).alias("env"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored times have no zone; they are taken as UTC."""
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return history_from(table(spark, sf_dir, "events").withColumn("ts", utc))


HISTORY = f"""history AS (SELECT event_type AS rule,
    CASE WHEN event_type = 'error' OR value < 20 THEN 'Failed' WHEN value > 150 THEN 'Pending' ELSE 'Passed' END AS status,
    props AS details, '/Users/u' || user_id AS notebook_path, sha256(event_id::VARCHAR) AS audit_id,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RULE_KEYS.items())} END AS rule_key,
    event_id AS seq, ts AS validation_timestamp, ts::DATE AS run_date, (user_id % 40)::INT AS pr_number, 'feature/' || (user_id % 40) AS pr_branch,
    ['dev', 'staging', 'prod'][user_id % 3 + 1] AS env FROM events)"""
WITH = "WITH " + HISTORY
COUNTS = "count(*) FILTER (WHERE status = 'Passed') AS passed, count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status = 'Pending') AS pending"


def rate(passed: str = "count(*) FILTER (WHERE status = 'Passed')", total: str = "count(*)") -> str:
    """Percent rounded half up to two decimals, in whole numbers."""
    return f"((20000 * {passed} + {total}) // (2 * {total})) / 100.0"


def printed(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that clients' date types do not matter."""
    shown = {}
    for c, t in df.dtypes:
        if t == "date":
            shown[c] = F.col(c).cast("string")
        elif t == "timestamp":
            shown[c] = F.date_format(utc_time(F.col(c)), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumns(shown)


STAMP = "strftime(validation_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS validation_timestamp"


# ---- summaries -------------------------------------------------------------------------
@query(
    "agg1_summary_total",
    f"""{WITH} SELECT count(*) AS total_results, count(*) FILTER (WHERE status = 'Passed') AS passed_results, count(*) FILTER (WHERE status = 'Failed') AS failed_results,
      count(*) FILTER (WHERE status = 'Pending') AS pending_results, count(*) FILTER (WHERE status = 'Passed')::DOUBLE / count(*)::DOUBLE AS pass_rate FROM history""",
)
def agg1(spark, sf_dir):
    return summary.summary_total(history(spark, sf_dir))


@query("agg2_summary_by_rule", f"{WITH} SELECT rule, {COUNTS} FROM history GROUP BY rule")
def agg2(spark, sf_dir):
    return summary.summary_by_rule(history(spark, sf_dir))


@query("agg2_rules_of_the_corpus", f"{o.WITH}, found AS {o.findings_sql()} SELECT rule, {COUNTS} FROM found GROUP BY rule")
def agg2_corpus(spark, sf_dir):
    """Summary of an audit, counted where findings would be made."""
    return counts.counted(corpus(spark, sf_dir)).by_rule()


@query(
    "agg4_cube_of_the_corpus",
    f"""{o.WITH}, found AS {o.findings_sql()} SELECT CASE grouping_id(rule, path) WHEN 3 THEN 'total' WHEN 1 THEN 'rule' ELSE 'notebook' END AS level, rule, path AS notebook_path, {COUNTS}
    FROM found GROUP BY GROUPING SETS ((), (rule), (path))""",
)
def agg4_corpus(spark, sf_dir):
    """All three summaries of an audit from its counters."""
    return counts.counted(corpus(spark, sf_dir)).stored().cube()


@query("agg3_summary_by_notebook", f"{WITH} SELECT notebook_path, {COUNTS} FROM history GROUP BY notebook_path")
def agg3(spark, sf_dir):
    return summary.summary_by_notebook(history(spark, sf_dir))


@query(
    "agg4_summary_cube",
    f"""{WITH} SELECT CASE grouping_id(rule, notebook_path) WHEN 3 THEN 'total' WHEN 1 THEN 'rule' ELSE 'notebook' END AS level, rule, notebook_path, {COUNTS}
    FROM history GROUP BY GROUPING SETS ((), (rule), (notebook_path))""",
)
def agg4(spark, sf_dir):
    return summary.summary_cube(history(spark, sf_dir))


WITH_SEVERITY = "graded AS (SELECT h.*, c.severity, c.domain FROM history h LEFT JOIN catalog c USING (rule_key))"


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellaudit.operators.catalog import attach_severity

    return attach_severity(history(spark, sf_dir), rule_catalog(spark))


@query(
    "agg5_summary_by_severity_category",
    f"{WITH}, {CATALOG}, {WITH_SEVERITY} SELECT severity, domain, grouping_id(severity, domain) AS level, {COUNTS} FROM graded GROUP BY ROLLUP (severity, domain)",
)
def agg5(spark, sf_dir):
    return summary.summary_by_severity_category(graded(spark, sf_dir))


@query(
    "agg6_batch_run_summary",
    f"""{o.WITH}, found AS {o.findings_sql()} SELECT count(DISTINCT path) AS total_notebooks,
      count(DISTINCT path) - count(*) FILTER (WHERE rule = {o.lit(fixed.ACCESS_LABEL)}) AS successful_validations, count(*) FILTER (WHERE rule = {o.lit(fixed.ACCESS_LABEL)}) AS failed_validations,
      count(*) FILTER (WHERE status = 'Passed') AS total_passed, count(*) FILTER (WHERE status = 'Failed') AS total_failed FROM found""",
)
def agg6(spark, sf_dir):
    return summary.batch_run_summary(engine.validate(corpus(spark, sf_dir)))


@query(
    "agg7_quality_gate",
    f"""{WITH}, {CATALOG}, {WITH_SEVERITY}, gates AS (SELECT pr_number, count(*) FILTER (WHERE status = 'Failed' AND severity = 'error') AS blocking FROM graded GROUP BY pr_number)
    SELECT pr_number, blocking, blocking = 0 AS gate_open, CASE WHEN blocking = 0 THEN 0 ELSE 1 END AS exit_code FROM gates""",
)
def agg7(spark, sf_dir):
    return summary.quality_gate(graded(spark, sf_dir), ["pr_number"], severity_floor="error")


# ---- reports ---------------------------------------------------------------------------
RECENT = f"WHERE validation_timestamp >= DATE '{AS_OF}' - INTERVAL 30 DAY AND validation_timestamp < DATE '{AS_OF}' + INTERVAL 1 DAY"


@query(
    "rpt1_daily_success_trend",
    f"""{WITH} SELECT run_date::VARCHAR AS date, count(*) AS total_validations, count(*) FILTER (WHERE status = 'Passed') AS passed, {rate()} AS success_rate
    FROM history {RECENT} GROUP BY run_date""",
)
def rpt1(spark, sf_dir):
    return printed(reports.daily_success_trend(history(spark, sf_dir), AS_OF))


@query(
    "rpt2_pr_success_rate",
    f"""{WITH} SELECT pr_number, pr_branch, count(*) AS total_validations, count(*) FILTER (WHERE status = 'Passed') AS passed_validations, {rate()} AS success_rate
    FROM history {RECENT} GROUP BY pr_number, pr_branch""",
)
def rpt2(spark, sf_dir):
    return reports.pr_success_rate(history(spark, sf_dir), AS_OF)


@query(
    "rpt3_latest_findings",
    f"""{WITH}, {CATALOG}, {WITH_SEVERITY} SELECT notebook_path, domain, rule, status, {STAMP}, audit_id
    FROM (SELECT * FROM graded ORDER BY graded.validation_timestamp DESC, audit_id LIMIT 100)""",
)
def rpt3(spark, sf_dir):
    return printed(reports.latest_findings(graded(spark, sf_dir)))


@query("rpt4_pr_detail", f"{WITH} SELECT pr_number, pr_branch, notebook_path, rule, status, {STAMP}, audit_id FROM history WHERE pr_number = 12")
def rpt4(spark, sf_dir):
    return printed(reports.pr_detail(history(spark, sf_dir), 12))


@query(
    "rpt5_failures_by_category",
    f"{WITH}, {CATALOG}, {WITH_SEVERITY} SELECT domain, count(*) AS failures FROM graded WHERE status = 'Failed' GROUP BY domain",
)
def rpt5(spark, sf_dir):
    return reports.failures_by_category(history(spark, sf_dir), rule_catalog(spark))


@query(
    "rpt6_top_offenders",
    f"{WITH} SELECT notebook_path, count(*) AS failures FROM history WHERE status = 'Failed' GROUP BY notebook_path ORDER BY failures DESC, notebook_path LIMIT 10",
)
def rpt6(spark, sf_dir):
    return reports.top_offenders(history(spark, sf_dir), 10)


@query(
    "rpt6_top_offenders_by_domain",
    f"""{WITH}, {CATALOG}, {WITH_SEVERITY}, counted AS (SELECT domain, notebook_path, count(*) AS failures FROM graded WHERE status = 'Failed' GROUP BY ALL)
    SELECT * FROM (SELECT *, rank() OVER (PARTITION BY domain ORDER BY failures DESC)::INT AS rank FROM counted) WHERE rank <= 5""",
)
def rpt6_domain(spark, sf_dir):
    return reports.top_offenders_by_domain(graded(spark, sf_dir), 5)


@query(
    "rpt7_failure_tickets",
    f"""{WITH} SELECT {o.lit(fixed.TICKET_TITLE)} || rule AS title, notebook_path AS notebook, details, audit_id FROM history
    WHERE status = 'Failed' AND run_date >= DATE '2024-01-15'""",
)
def rpt7(spark, sf_dir):
    """Tickets were filed up to the middle of the month."""
    all_findings = history(spark, sf_dir)
    filed = all_findings.filter(F.col("run_date") < F.lit("2024-01-15").cast("date")).select("audit_id")
    return reports.failure_tickets(all_findings, filed, by=["audit_id"])


def _lengths(*values: str) -> str:
    return ", ".join(f"length(coalesce({v}, ''))::VARCHAR, coalesce({v}, '')" for v in values)


# Failures of two nights, numbered among equal ones of the same notebook.
TICKETS = f"""{WITH}, failed AS (SELECT notebook_path AS notebook, rule, rule_key, details, run_date < DATE '2024-01-15' AS early FROM history WHERE status = 'Failed'),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY early, notebook, rule, rule_key, details)::INT AS occurrence FROM failed),
  tickets AS (SELECT *, sha256(concat_ws('|', {_lengths("''", 'rule_key', 'notebook', 'details')}, (details IS NULL)::VARCHAR, occurrence::VARCHAR)) AS ticket_id FROM numbered),
  early AS (SELECT * FROM tickets WHERE early), late AS (SELECT * FROM tickets WHERE NOT early)"""


def nights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, middle = history(spark, sf_dir), F.lit("2024-01-15").cast("date")
    return found.filter(F.col("run_date") < middle), found.filter(F.col("run_date") >= middle)


@query(
    "rpt7_second_night_files_only_new",
    f"""{TICKETS} SELECT ticket_id, {o.lit(fixed.TICKET_TITLE)} || rule AS title, notebook, details, occurrence FROM late WHERE ticket_id NOT IN (SELECT ticket_id FROM early)""",
)
def rpt7_second(spark, sf_dir):
    """What was filed in the first night is known in the second, whatever run saw it."""
    first, second = nights(spark, sf_dir)
    return reports.failure_tickets(second, reports.failure_tickets(first))


@query(
    "rpt7_ticket_ledger",
    f"""{TICKETS}, looked AS (SELECT DISTINCT notebook_path AS notebook FROM history WHERE run_date >= DATE '2024-01-15')
    SELECT coalesce(l.ticket_id, e.ticket_id) AS ticket_id, coalesce(l.notebook, e.notebook) AS notebook, coalesce(l.occurrence, e.occurrence) AS occurrence,
      CASE WHEN l.ticket_id IS NULL AND coalesce(l.notebook, e.notebook) IN (SELECT notebook FROM looked) THEN 'closed' ELSE 'open' END AS state,
      CASE WHEN e.ticket_id IS NULL THEN 'second' ELSE 'first' END AS opened_run,
      CASE WHEN l.ticket_id IS NULL AND e.notebook IN (SELECT notebook FROM looked) THEN 'second' END AS closed_run, 0::INT AS reopened,
      CASE WHEN e.ticket_id IS NULL THEN 'opened' WHEN l.ticket_id IS NOT NULL THEN 'still open' WHEN e.notebook IN (SELECT notebook FROM looked) THEN 'closed' ELSE 'unchanged' END AS action
    FROM late l FULL OUTER JOIN early e ON l.ticket_id = e.ticket_id""",
)
def rpt7_ledger(spark, sf_dir):
    first, second = nights(spark, sf_dir)
    ledger = reports.ticket_ledger(second, reports.ticket_ledger(first, run_id="first"), "second")
    return ledger.select("ticket_id", "notebook", "occurrence", "state", "opened_run", "closed_run", "reopened", "action")


def _payload_counts(prefix: str = "") -> str:
    return ", ".join(f"'\"{s.lower()}{prefix}\":' || count(*) FILTER (WHERE status = '{s}')" for s in fixed.STATUSES)


NOTEBOOK_JSON = "'{' || concat_ws(',', " + _payload_counts() + ") || '}'"


@query(
    "rpt8_monitoring_payload",
    f"""{WITH},
    rules AS (SELECT rule, '"' || rule || '":' || {NOTEBOOK_JSON} AS part FROM history GROUP BY rule),
    run AS (SELECT '{{' || concat_ws(',', '"total_results":' || count(*), {_payload_counts('_results')}, '"rule_summary":{{' || (SELECT string_agg(part, ',' ORDER BY rule) FROM rules) || '}}') || '}}' AS payload FROM history)
    SELECT 'run' AS kind, '' AS name, payload FROM run
    UNION ALL SELECT 'notebook', notebook_path, {NOTEBOOK_JSON} FROM history GROUP BY notebook_path""",
)
def rpt8(spark, sf_dir):
    """The pass rate is left out of the compared text: engines print doubles differently."""
    payload = reports.monitoring_payload(history(spark, sf_dir))
    return payload.withColumn("payload", F.regexp_replace("payload", '"pass_rate":[^,]*,', ""))


def by_environment(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each environment's own table; production has columns the others lack."""
    everything = history(spark, sf_dir)
    tables = {env: everything.filter(F.col("env") == env).drop("env", "pr_number", "pr_branch") for env in ENVIRONMENTS}
    tables["prod"] = everything.filter(F.col("env") == "prod").drop("env")
    return tables


@query(
    "rpt9_multi_env_report",
    f"{WITH} SELECT rule, {', '.join(f'''count(*) FILTER (WHERE env = '{e}') AS {e}''' for e in ENVIRONMENTS)} FROM history WHERE status = 'Failed' GROUP BY rule",
)
def rpt9(spark, sf_dir):
    return reports.multi_env_report(by_environment(spark, sf_dir))


@query(
    "rpt10_multi_repo_report",
    f"{WITH} SELECT env AS repo, count(*) AS total_validations, count(*) FILTER (WHERE status = 'Passed') AS passed, {rate()} AS success_rate FROM history GROUP BY env",
)
def rpt10(spark, sf_dir):
    return reports.multi_repo_report(by_environment(spark, sf_dir))


@query(
    "rpt11_regressions",
    f"""{WITH}, seen AS (SELECT notebook_path, rule, run_date, bool_or(status = 'Failed') AS failed FROM history GROUP BY ALL),
    runs AS (SELECT notebook_path, rule, run_date, coalesce(failed, FALSE) AS failed
      FROM (SELECT DISTINCT notebook_path, run_date FROM seen) JOIN (SELECT DISTINCT notebook_path, rule FROM seen) USING (notebook_path) LEFT JOIN seen USING (notebook_path, rule, run_date)),
    compared AS (SELECT *, lag(failed) OVER (PARTITION BY notebook_path, rule ORDER BY run_date) AS before FROM runs)
    SELECT notebook_path, rule, run_date::VARCHAR AS run_date, CASE WHEN failed THEN 'newly failing' ELSE 'newly fixed' END AS change FROM compared WHERE failed <> before""",
)
def rpt11(spark, sf_dir):
    return printed(reports.regressions(history(spark, sf_dir)))


RUN = "'run-' || run_date || CASE WHEN hour(validation_timestamp) < 12 THEN '-2' ELSE '-1' END"


@query(
    "rpt11_regressions_by_run",
    f"""{WITH}, seen AS (SELECT notebook_path, rule, {RUN} AS validation_run_id, bool_or(status = 'Failed') AS failed, max(validation_timestamp) AS latest FROM history GROUP BY ALL),
    looked AS (SELECT notebook_path, validation_run_id, max(latest) AS latest FROM seen GROUP BY ALL),
    runs AS (SELECT notebook_path, rule, validation_run_id, latest, coalesce(failed, FALSE) AS failed
      FROM looked JOIN (SELECT DISTINCT notebook_path, rule FROM seen) USING (notebook_path) LEFT JOIN (SELECT * EXCLUDE latest FROM seen) USING (notebook_path, rule, validation_run_id)),
    compared AS (SELECT *, lag(failed) OVER (PARTITION BY notebook_path, rule ORDER BY latest, validation_run_id) AS before FROM runs)
    SELECT notebook_path, rule, validation_run_id, latest::DATE::VARCHAR AS run_date, CASE WHEN failed THEN 'newly failing' ELSE 'newly fixed' END AS change FROM compared WHERE failed <> before""",
)
def rpt11_by_run(spark, sf_dir):
    """Two runs a day, whose ids sort against their times."""
    found = history(spark, sf_dir)
    early = F.hour(utc_time(F.col("validation_timestamp"))) < 12
    run = F.concat(F.lit("run-"), F.col("run_date").cast("string"), F.when(early, "-2").otherwise("-1"))
    return printed(reports.regressions(found.withColumn("validation_run_id", run)))


@query(
    "rpt5_failures_of_the_corpus",
    f"""{o.WITH}, found AS {o.findings_sql()} SELECT domain, count(*) AS failures FROM found WHERE status = 'Failed' GROUP BY domain""",
)
def rpt5_corpus(spark, sf_dir):
    """Over findings of an audit, those included that no rule of the catalog made."""
    return reports.failures_by_category(engine.validate(corpus(spark, sf_dir)), rule_catalog(spark))


# ---- reports on a history that audits wrote -------------------------------------------
RUNS_WRITTEN = {"run-a": "2024-01-30 08:00:00", "run-c": "2024-01-31 08:00:00", "run-b": "2024-01-31 20:00:00"}


def written_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three audits on two days: the corpus as it was before, as it is, and as it was before again."""
    location = shared.new_location(spark, "history")
    for run, time in RUNS_WRITTEN.items():
        books = corpus(spark, sf_dir) if run == "run-c" else corpus_before(spark, sf_dir)
        stamp = F.from_utc_timestamp(F.to_timestamp_ntz(F.lit(time)).cast("timestamp"), F.current_timezone())
        store.append_history(engine.validate(books, run_id=run), location, run, "nightly", stamp, audited=books)
    return store.load_findings(spark, location), store.load_roster(spark, location)


BEFORE = """(SELECT doc_id, CASE WHEN n_chars > 3000 THEN text || chr(10) || 'GRANT x' ELSE text END AS text FROM documents WHERE lang <> 'fr'
  UNION ALL SELECT doc_id + 100000000, text FROM documents WHERE lang = 'de')"""


def _run_sql(run: str) -> str:
    books = o.NOTEBOOKS if run == "run-c" else o.NOTEBOOKS.replace("FROM documents", f"FROM {BEFORE}")
    return (
        f"SELECT path AS notebook_path, rule, rule_key, domain, severity, status, '{run}' AS validation_run_id, TIMESTAMP '{RUNS_WRITTEN[run]}' AS validation_timestamp "
        f"FROM (WITH {books.strip()}, found AS {o.findings_sql()} SELECT * FROM found)"
    )


WRITTEN_HISTORY = f"WITH written AS MATERIALIZED ({' UNION ALL '.join(_run_sql(run) for run in RUNS_WRITTEN)})"


@query(
    "rpt11_regressions_of_written_history",
    f"""{WRITTEN_HISTORY}, seen AS (SELECT notebook_path, rule, validation_run_id, bool_or(status = 'Failed') AS failed, max(validation_timestamp) AS latest FROM written GROUP BY ALL),
    looked AS (SELECT notebook_path, validation_run_id, max(latest) AS latest FROM seen GROUP BY ALL),
    runs AS (SELECT notebook_path, rule, validation_run_id, looked.latest AS latest, coalesce(failed, FALSE) AS failed
      FROM looked JOIN (SELECT DISTINCT notebook_path, rule FROM seen) USING (notebook_path) LEFT JOIN (SELECT * EXCLUDE latest FROM seen) USING (notebook_path, rule, validation_run_id)),
    compared AS (SELECT *, lag(failed) OVER (PARTITION BY notebook_path, rule ORDER BY latest) AS before FROM runs)
    SELECT notebook_path, rule, validation_run_id, latest::DATE::VARCHAR AS run_date, CASE WHEN failed THEN 'newly failing' ELSE 'newly fixed' END AS change FROM compared WHERE failed <> before""",
)
def rpt11_written(spark, sf_dir):
    """Rules that give rows only where they fail are fixed by giving none, and fail again."""
    found, roster = written_history(spark, sf_dir)
    return printed(reports.regressions(found, roster))


@query(
    "rpt1_trend_of_written_history",
    f"""{WRITTEN_HISTORY} SELECT validation_timestamp::DATE::VARCHAR AS date, count(*) AS total_validations, count(*) FILTER (WHERE status = 'Passed') AS passed, {rate()} AS success_rate
    FROM written GROUP BY ALL""",
)
def rpt1_written(spark, sf_dir):
    return printed(reports.daily_success_trend(written_history(spark, sf_dir)[0], AS_OF))


@query(
    "agg5_severity_of_written_history",
    f"{WRITTEN_HISTORY} SELECT severity, domain, grouping_id(severity, domain) AS level, {COUNTS} FROM written GROUP BY ROLLUP (severity, domain)",
)
def agg5_written(spark, sf_dir):
    return summary.summary_by_severity_category(written_history(spark, sf_dir)[0])


@query(
    "agg7_gate_of_written_history",
    f"""{WRITTEN_HISTORY}, gates AS (SELECT validation_run_id, count(*) FILTER (WHERE status = 'Failed' AND severity = 'error') AS blocking FROM written GROUP BY ALL)
    SELECT validation_run_id, blocking, blocking = 0 AS gate_open, CASE WHEN blocking = 0 THEN 0 ELSE 1 END AS exit_code FROM gates""",
)
def agg7_written(spark, sf_dir):
    return summary.quality_gate(written_history(spark, sf_dir)[0], ["validation_run_id"], severity_floor="error")


# ---- increments ------------------------------------------------------------------------
def corpus_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of the run before: French documents were not there yet, long ones
    had another ending, and there were notebooks that are gone by now."""
    now = documents(spark, sf_dir)
    was = now.filter(F.col("lang") != "fr").withColumn(
        "text", F.when(F.col("n_chars") > 3000, F.concat("text", F.lit("\nGRANT x"))).otherwise(F.col("text"))
    )
    gone = now.filter(F.col("lang") == "de").withColumn("doc_id", F.col("doc_id") + 100_000_000)
    return notebooks_from(was.unionByName(gone))


@query(
    "inc1_changed_only",
    # where cells are an object, the notebook does not hold the text that was changed
    f"{o.WITH} SELECT path FROM nb JOIN documents ON doc_id = d WHERE lang = 'fr' OR (n_chars > 3000 AND k <> {o.fx.CELLS_OBJECT})",
)
def inc1(spark, sf_dir):
    now = corpus(spark, sf_dir)
    changed = incremental.changed_paths(now, incremental.snapshot(corpus_before(spark, sf_dir)))
    return incremental.changed_only(now, changed).select("path")


@query(
    "inc1_changed_against_a_bucketed_snapshot",
    f"{o.WITH} SELECT path FROM nb JOIN documents ON doc_id = d WHERE lang = 'fr' OR (n_chars > 3000 AND k <> {o.fx.CELLS_OBJECT})",
)
def inc1_bucketed(spark, sf_dir):
    """The snapshot kept as a bucketed table; compared without shuffling it."""
    location = shared.new_location(spark, "snapshot")
    name = "snapshot_" + location.rsplit("-", 1)[1]
    incremental.write_snapshot(incremental.snapshot(corpus_before(spark, sf_dir)), name, 16, location)
    return incremental.changed_paths(corpus(spark, sf_dir), spark.table(name))


@query("inc2_reuse_unchanged", o.all_findings_sql())
def inc2(spark, sf_dir):
    """Old findings kept and changed notebooks audited again: as if all had been."""
    before = corpus_before(spark, sf_dir)
    findings_before = shared.stored(engine.validate(before), "before")
    found = incremental.reuse_unchanged(corpus(spark, sf_dir), incremental.snapshot(before), findings_before)
    return found.select(*SHOWN)


FILES = """files AS (SELECT CASE WHEN lang = 'en' THEN 'notebooks/' WHEN lang = 'fr' THEN 'src/' ELSE 'notebooks/sub/' END || source || '/f' || doc_id
  || CASE WHEN n_chars % 2 = 0 THEN '.py' ELSE '.sql' END AS file_path FROM documents)"""


@query(
    "inc4_repo_to_workspace_path",
    f"""WITH {FILES} SELECT file_path, '/Workspace/Repos/org/repo/' || CASE WHEN starts_with(file_path, 'notebooks/') THEN regexp_replace(file_path, '\\.py$', '') ELSE file_path END AS workspace_path FROM files""",
)
def inc4(spark, sf_dir):
    folder = F.when(F.col("lang") == "en", "notebooks/").when(F.col("lang") == "fr", "src/").otherwise("notebooks/sub/")
    ending = F.when(F.col("n_chars") % 2 == 0, ".py").otherwise(".sql")
    name = F.concat(folder, "source", F.lit("/f"), F.col("doc_id").cast("string"), ending)
    files = table(spark, sf_dir, "documents").select(name.alias("file_path"))
    return files.withColumn("workspace_path", incremental.repo_to_workspace_path(F.col("file_path"), "org/repo"))


# ---- sinks and the history table -------------------------------------------------------
def _written(details: str) -> str:
    return f"{o.WITH}, found AS {o.findings_sql()} SELECT rule, status, {details} AS details, path AS notebook_path, {o.audit_id()} AS audit_id FROM found"


WRITTEN = _written(o.masked())
KIND = 4  # first characters of a found secret that tell its kind
WRITTEN_BY_KIND = _written(o.masked(shown=KIND))
FIELDS = ["rule", "status", "details", "notebook_path", "audit_id"]


@query("snk2_write_table", WRITTEN_BY_KIND)
def snk2(spark, sf_dir):
    """Written as a table of the session's catalog, read back by name; kinds of secrets can be told apart."""
    location = shared.new_location(spark, "table")
    name = "findings_" + location.rsplit("-", 1)[1]
    store.write_table(engine.validate(corpus(spark, sf_dir)), name, path=location, shown=KIND)
    return spark.table(name).select(*FIELDS)


@query(
    "snk3_append_history",
    f"""{WITH} SELECT notebook_path, rule, status, audit_id, run_date::VARCHAR AS run_date, 'run-' || CASE WHEN env = 'prod' THEN 'b' ELSE 'a' END AS validation_run_id,
      'test' AS validation_source, CASE WHEN env = 'prod' THEN pr_branch END AS pr_branch FROM history""",
)
def snk3(spark, sf_dir):
    """Two runs appended, the second with a column more; read back with both schemas."""
    location = shared.new_location(spark, "history")
    everything = history(spark, sf_dir).drop("run_date", "pr_number")
    stamp = F.col("validation_timestamp")
    store.append_history(everything.filter(F.col("env") != "prod").drop("pr_branch"), location, "run-a", "test", stamp)
    store.append_history(everything.filter(F.col("env") == "prod"), location, "run-b", "test", stamp)
    back = store.load_findings(spark, location)
    return printed(back).select("notebook_path", "rule", "status", "audit_id", "run_date", "validation_run_id", "validation_source", "pr_branch")


@query(
    "src7_load_findings",
    f"{WITH} SELECT run_date::VARCHAR AS run_date, status, count(*) AS n FROM history WHERE run_date >= DATE '2024-01-20' GROUP BY ALL",
)
def src7(spark, sf_dir):
    """The stored history, only its latest days read."""
    location = shared.new_location(spark, "history")
    everything = history(spark, sf_dir).drop("run_date")
    store.append_history(everything, location, "run-a", "test", F.col("validation_timestamp"))
    recent = store.load_findings(spark, location).filter(F.col("run_date") >= F.lit("2024-01-20").cast("date"))
    return printed(recent.groupBy("run_date", "status").agg(F.count(F.lit(1)).alias("n")))


@query("snk4_write_json", WRITTEN)
def snk4(spark, sf_dir):
    location = shared.new_location(spark, "json")
    found = engine.validate(corpus(spark, sf_dir))
    store.write_json(found, location)
    return spark.read.schema(found.select(*store.FIELDS).schema).json(location).select(*FIELDS)


@query("snk5_write_csv", WRITTEN_BY_KIND)
def snk5(spark, sf_dir):
    """Written as CSV, read back; kinds of secrets can be told apart."""
    location = shared.new_location(spark, "csv")
    found = engine.validate(corpus(spark, sf_dir))
    store.write_csv(found, location, shown=KIND)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.schema(found.select(*store.FIELDS).schema).csv(location).select(*FIELDS)


def _html(value: str) -> str:
    return f"replace(replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    "snk6_html_rows",
    f"""{o.WITH}, found AS {o.findings_sql()}
    SELECT path AS notebook_path, 'head' AS part, '<h2>' || {_html('path')} || '</h2><p>Total validations: ' || count(*) || '</p><p class="passed">Passed: ' || count(*) FILTER (WHERE status = 'Passed')
      || '</p><p class="failed">Failed: ' || count(*) FILTER (WHERE status = 'Failed') || '</p><p class="pending">Pending: ' || count(*) FILTER (WHERE status = 'Pending') || '</p>' AS html FROM found GROUP BY path
    UNION ALL SELECT path, 'row', '<tr><td>' || {_html('path')} || '</td><td>' || {_html('rule')} || '</td><td class="' || lower(status) || '">' || status || '</td><td>' || {_html('details')} || '</td></tr>' FROM found""",
)
def snk6(spark, sf_dir):
    return store.html_rows(engine.validate(corpus(spark, sf_dir))).select("notebook_path", "part", "html")


# ---- streams ---------------------------------------------------------------------------
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stream(spark: SparkSession, sf_dir: str, name: str, schema: str | T.StructType) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


@query("str1_scheduled_audit", o.all_findings_sql("schedule-0"))
def str1(spark, sf_dir):
    """Notebooks arriving on a stream, audited in one scheduled run."""
    arriving = notebooks_from(stream(spark, sf_dir, "documents", DOCUMENTS))
    location = shared.new_location(spark, "audited")
    jobs.scheduled_audit(arriving, location, shared.new_location(spark, "progress"), redact=False).awaitTermination()
    return spark.read.parquet(location).select(*SHOWN)


@query(
    "str2_streaming_trend",
    f"""{WITH} SELECT run_date::VARCHAR AS date, count(*) AS total_validations, count(*) FILTER (WHERE status = 'Passed') AS passed FROM history
    WHERE run_date + INTERVAL 1 DAY <= (SELECT max(validation_timestamp) FROM history) - INTERVAL 1 DAY GROUP BY run_date""",
)
def str2(spark, sf_dir):
    """Days closed by the watermark, from a stream that delivers every finding twice."""
    schema = table(spark, sf_dir, "events").schema
    # the stored times have no zone; taken as UTC
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    arriving = stream(spark, sf_dir, "events", schema).withColumn("ts", utc)
    twice = arriving.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).select(*schema.names)
    location = shared.new_location(spark, "trend")
    jobs.run_trend(history_from(twice), location, shared.new_location(spark, "progress")).awaitTermination()
    return printed(spark.read.parquet(location))
