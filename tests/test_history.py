"""Increments, sinks, reports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import code_cell, notebook

from cellaudit.functions import fixed, shared
from cellaudit.operators import engine, incremental
from cellaudit.operators.catalog import DEFAULT_CATALOG, enable_rules
from cellaudit.plans import reports
from cellaudit.sources import findings as store
from cellaudit.streaming import jobs
from workload import QUERIES

CORPUS = "path string, content string"


def books(spark, **code):
    return spark.createDataFrame([(p, notebook(code_cell(c))) for p, c in code.items()], CORPUS)


def plain(df):
    return sorted(map(tuple, df.drop("audit_time").collect()), key=str)


def test_increment_equals_full_run(spark):
    before, now = books(spark, a="x", b="y", gone="z"), books(spark, a="x", b="SELECT *", new="w")
    snapshot, old = incremental.snapshot(before), shared.stored(engine.validate(before), "old")
    changed = incremental.changed_paths(now, snapshot)
    assert sorted(r["path"] for r in changed.collect()) == ["b", "new"]
    assert plain(incremental.reuse_unchanged(now, snapshot, old)) == plain(engine.validate(now))


def test_other_rules_change_everything(spark):
    now = books(spark, a="x", b="y")
    other = enable_rules(DEFAULT_CATALOG, on=["data_isolation"])
    assert incremental.changed_paths(now, incremental.snapshot(now), other).count() == 2
    assert incremental.changed_paths(now, incremental.snapshot(now)).count() == 0


def test_small_change_lists_do_not_move_notebooks(spark):
    now = shared.stored(books(spark, a="x", b="y"), "corpus")
    changed = incremental.changed_paths(now, incremental.snapshot(books(spark, a="x")))
    plan = incremental.changed_only(now, changed)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_only_hashes_are_shuffled_to_find_changes(spark):
    now = shared.stored(books(spark, a="x"), "corpus")
    joined = incremental.unlike_before(incremental.snapshot(now), incremental.snapshot(now))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("content#" not in line for line in exchanges)


def test_a_bucketed_snapshot_is_not_shuffled(spark, tmp_path):
    first, second = books(spark, a="x", b="y", gone="z"), books(spark, a="x", b="other", new="w")
    incremental.write_snapshot(incremental.snapshot(first), "seen_before", 8, str(tmp_path / "seen"))
    before, now = spark.table("seen_before"), shared.stored(second, "corpus")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (incremental.unlike_before(incremental.snapshot(now), before), incremental.upserted(before, incremental.snapshot(now))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SelectedBucketsCount: 8 out of 8" in plan
        assert sorted(r["path"] for r in incremental.changed_paths(now, before).collect()) == ["b", "new"]
        after = incremental.upserted(before, incremental.snapshot(second))
        assert sorted(r["path"] for r in after.collect()) == ["a", "b", "gone", "new"]
        assert incremental.changed_paths(second, shared.stored(after, "after")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE seen_before")


@pytest.fixture(scope="module")
def secret(spark):
    return engine.validate(books(spark, a='password = "hunter2, & \'more"\nCREATE TABLE "x" (a VARCHAR(3))'))


def test_secrets_are_masked_where_stored(spark, secret):
    masked = store.redact_secrets(secret).filter(F.col("rule") == fixed.LABEL_SECRETS).first()["details"]
    assert masked == fixed.SECRET_FOUND + "***"
    assert "hunter2" in secret.filter(F.col("rule") == fixed.LABEL_SECRETS).first()["details"]


@pytest.fixture(scope="module")
def three_kinds(spark, tmp_path_factory):
    """Documents whose notebooks hold one secret of each kind: ``d % 11`` is 0 or 1."""
    folder = tmp_path_factory.mktemp("kinds")
    rows = [(d, f"x = {d}", "en", "src", 5) for d in (11, 12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def kinds_shown(spark, query, folder):
    return sorted(r["details"] for r in QUERIES[query](spark, folder).filter(F.startswith("details", F.lit(fixed.SECRET_FOUND))).collect())


KINDS = [fixed.SECRET_FOUND + kind + "***" for kind in ("Bear", "dapi", "pass")]


def test_a_written_table_tells_kinds_of_secrets(spark, three_kinds):
    assert kinds_shown(spark, "snk2_write_table", three_kinds) == KINDS


def test_written_csv_tells_kinds_of_secrets(spark, three_kinds):
    assert kinds_shown(spark, "snk5_write_csv", three_kinds) == KINDS


def test_files(spark, secret, tmp_path):
    fields = secret.select(*store.FIELDS)
    store.write_json(secret, str(tmp_path / "json"), redact=False)
    assert plain(spark.read.schema(fields.schema).json(str(tmp_path / "json"))) == plain(fields)
    lines = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert all(list(line) == store.FIELDS for line in lines)
    store.write_csv(secret, str(tmp_path / "csv"), redact=False)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(fields.schema)
    assert plain(back.csv(str(tmp_path / "csv"))) == plain(fields)
    store.write_html(secret, str(tmp_path / "html"), redact=False)
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "html").glob("*.txt")))
    assert text.startswith("<h2>a</h2>") and "&amp;" in text and text.count("<tr>") == secret.count()


def test_table(spark, secret, tmp_path):
    with pytest.raises(ValueError):
        store.write_table(None, "nothing")
    for mode in ("overwrite", "append"):
        store.write_table(secret, "audit_test", mode=mode, path=str(tmp_path / "table"))
    assert spark.table("audit_test").count() == 2 * secret.count()
    store.write_table(secret, "audit_test", fmt="parquet", path=str(tmp_path / "table"))
    assert spark.table("audit_test").count() == secret.count()


def test_history_prunes_days(spark, secret, tmp_path):
    location = str(tmp_path / "history")
    for day in ("2024-01-01", "2024-01-02"):
        store.append_history(secret, location, f"run-{day}", "test", F.lit(f"{day} 02:00:00").cast("timestamp"))
    history = store.load_findings(spark, location)
    trend = reports.daily_success_trend(history, "2024-02-01", days=30)
    plan = trend._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan
    assert [str(r["date"]) for r in trend.collect()] == ["2024-01-02"]


def history_rows(spark, rows):
    return spark.createDataFrame(rows, "notebook_path string, rule string, status string, run_date string").withColumn(
        "run_date", F.to_date("run_date")
    )


def test_regressions(spark):
    rows = [
        ("a", "R", "Passed", "2024-01-01"), ("a", "R", "Failed", "2024-01-02"), ("a", "R", "Passed", "2024-01-02"), ("a", "R", "Pending", "2024-01-05"),
        ("b", "R", "Failed", "2024-01-01"), ("b", "R", "Failed", "2024-01-02"), ("c", "R", "Failed", "2024-01-02"),
    ]
    found = reports.regressions(history_rows(spark, rows)).collect()
    assert sorted((r["notebook_path"], str(r["run_date"]), r["change"]) for r in found) == [
        ("a", "2024-01-02", "newly failing"), ("a", "2024-01-05", "newly fixed"),
    ]


@pytest.mark.parametrize("with_roster", [False, True])
def test_regressions_by_plain_loops_and_one_join(spark, with_roster):
    import random

    pick = random.Random(7).choice
    rows = [(pick(["a", "b", None]), pick(["R", "S", None]), pick(["Passed", "Failed", "Pending", None]), pick(["r1", "r2", "r3", "r4", None]), pick([1, 2, 3, None])) for _ in range(90)]
    schema = "notebook_path string, rule string, status string, validation_run_id string, at int"
    stamped = {"validation_timestamp": F.timestamp_seconds(F.col("at") * 86400)}
    history = spark.createDataFrame(rows, schema).withColumns(stamped)
    looks = [(p, None, None, r, t) for p, r, t in [("a", "r5", 2), ("b", "r0", 3), ("a", "r1", 3), ("c", "r1", 1)]] if with_roster else []
    roster = spark.createDataFrame(looks, schema).withColumns(stamped).drop("rule", "status", "at") if with_roster else None
    expected = []
    for path in "ab":
        latest = {}
        for p, _, _, run, at in rows + looks:
            if p == path:
                latest[run] = max(latest.get(run, -1), -1 if at is None else at)
        order = sorted(latest, key=lambda r: (latest[r], r is not None, r or ""))
        for rule in "RS":
            fails = [r is not None and (path, rule, "Failed", r) in {x[:4] for x in rows} for r in order]
            for k in range(1, len(order)):
                if fails[k] != fails[k - 1]:
                    expected.append((path, rule, order[k], None if latest[order[k]] < 0 else f"1970-01-0{latest[order[k]] + 1}", "newly failing" if fails[k] else "newly fixed"))
    found = reports.regressions(history, roster)
    assert found.columns == ["notebook_path", "rule", "validation_run_id", "run_date", "change"]
    assert sorted(((r[0], r[1], r[2], r[3] and str(r[3]), r[4]) for r in found.collect()), key=str) == sorted(expected, key=str) and len(expected) > 5
    # failures meet the runs once; passed findings are in no join
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_ranks_are_found_among_numbers_of_failures(spark):
    rows = [("d", f"n{i % 7}", "Failed") for i in range(100)]
    found = spark.createDataFrame(rows, "domain string, notebook_path string, status string")
    top = reports.top_offenders_by_domain(found, 2)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "notebook_path" not in windows[0]
    assert sorted((r["notebook_path"], r["failures"], r["rank"]) for r in top.collect()) == [("n0", 15, 1), ("n1", 15, 1)]


def test_latest_keeps_n_per_task(spark):
    rows = [(str(i), i) for i in range(500)]
    found = spark.createDataFrame(rows, "audit_id string, t int").select(
        "audit_id", F.lit("p").alias("notebook_path"), F.lit("d").alias("domain"), F.lit("r").alias("rule"), F.lit("Passed").alias("status"),
        F.timestamp_seconds("t").alias("validation_timestamp"),
    )
    latest = reports.latest_findings(found, 100)
    assert "TakeOrderedAndProject" in latest._jdf.queryExecution().executedPlan().toString()
    assert [r["audit_id"] for r in latest.collect()][:2] == ["499", "498"]


FAILED = "rule string, status string, notebook_path string, details string, audit_id string"


def failures(spark, *rows):
    """(notebook, rule, details), each a failure; ids differ from call to call."""
    return spark.createDataFrame([(r, "Failed", n, d, str(i)) for i, (n, r, d) in enumerate(rows)], FAILED)


def test_tickets_by_given_columns(spark):
    found = spark.createDataFrame([("R", "Failed", "a", "d", "1"), ("R", "Failed", "b", "d", "2"), ("R", "Passed", "c", "d", "3")], FAILED)
    filed = spark.createDataFrame([("1",)], "audit_id string")
    assert [r["notebook"] for r in reports.failure_tickets(found, filed, ["audit_id"]).collect()] == ["b"]
    first, second = found, spark.createDataFrame([("R", "Failed", "a", "d", "7"), ("R", "Failed", "a", None, "8")], FAILED)
    assert [r["details"] for r in reports.failure_tickets(second, first, reports.SAME_FAILURE).collect()] == [None]


def test_a_failure_is_filed_once_whatever_run_sees_it(spark):
    first = failures(spark, ("a", "R", "d"), ("a", "R", None), ("a", "R", "e"))
    second = failures(spark, ("a", "R", None), ("a", "R", "e"), ("a", "R", "e"), ("a", "S", "e"), ("b", "R", "d"))
    filed = reports.failure_tickets(first)
    assert filed.count() == 3
    new = reports.failure_tickets(second, filed).collect()
    assert sorted((r["notebook"], r["title"][-1], r["details"], r["occurrence"]) for r in new) == [("a", "R", "e", 2), ("a", "S", "e", 1), ("b", "R", "d", 1)]
    assert reports.failure_tickets(second, filed.unionByName(reports.failure_tickets(second, filed))).count() == 0


def test_own_rules_with_one_label_have_tickets_of_their_own(spark):
    rows = [("custom", k, "Same", "Failed", "n", "d") for k in ("one", "two")]
    found = spark.createDataFrame(rows, "domain string, rule_key string, rule string, status string, notebook_path string, details string")
    assert reports.failure_tickets(found).select("ticket_id").distinct().count() == 2


def test_ledger(spark):
    nights = [
        failures(spark, ("a", "R", "d"), ("a", "R", "e"), ("b", "R", "d")),
        failures(spark, ("a", "R", "e")).unionByName(spark.createDataFrame([("R", "Passed", "c", "x", "9")], FAILED)),
        failures(spark, ("a", "R", "d"), ("c", "R", "n")),
    ]
    ledger, seen = None, []
    for i, night in enumerate(nights):
        ledger = shared.stored(reports.ticket_ledger(night, ledger, f"n{i}"), "ledger")
        seen.append({(r["notebook"], r["details"]): (r["state"], r["action"], r["opened_run"], r["closed_run"], r["reopened"]) for r in ledger.collect()})
    assert seen[0] == {k: ("open", "opened", "n0", None, 0) for k in (("a", "d"), ("a", "e"), ("b", "d"))}
    assert seen[1] == {("a", "d"): ("closed", "closed", "n0", "n1", 0), ("a", "e"): ("open", "still open", "n0", None, 0), ("b", "d"): ("open", "unchanged", "n0", None, 0)}
    assert seen[2] == {
        ("a", "d"): ("open", "reopened", "n0", None, 1), ("a", "e"): ("closed", "closed", "n0", "n2", 0),
        ("b", "d"): ("open", "unchanged", "n0", None, 0), ("c", "n"): ("open", "opened", "n2", None, 0),
    }
    everything = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    closed = reports.ticket_ledger(nights[1].filter("status = 'Passed'"), ledger, "n3", audited=everything)
    assert {r["state"] for r in closed.collect()} == {"closed"}
    # closed failures are filed again
    assert reports.failure_tickets(nights[2], closed).count() == 2


def test_ids_tell_rules_with_one_label_apart(spark):
    cut = "path string, domain string, rule_key string, rule string, severity string, status string, details string, seq int"
    same = [("a|b", "custom", key, "Same", "error", "Failed", "d", 0) for key in ("one", "two")]
    rows = spark.createDataFrame([*same, ("a", "custom", "one", "b|Same", "error", "Failed", "d", 0)], cut)
    ids = engine.identified(rows.withColumnRenamed("path", "notebook_path")).select("audit_id").distinct()
    assert ids.count() == 3


def test_scheduled_audit_sees_each_notebook_once(spark, tmp_path):
    incoming, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for wave in (books(spark, a="x", b="SELECT *"), books(spark, c="y")):
        wave.write.mode("append").parquet(incoming)
        arriving = spark.readStream.schema(CORPUS).parquet(incoming)
        jobs.scheduled_audit(arriving, out, progress).awaitTermination()
    written = store.load_findings(spark, out)
    assert {"validation_run_id", "validation_timestamp", "run_date"} <= set(written.columns)
    shown = [c for c in engine.FINDING_COLUMNS if c != "audit_id"]
    assert plain(written.select(*shown)) == plain(engine.validate(books(spark, a="x", b="SELECT *", c="y")).select(*shown))
    assert {r["validation_run_id"] for r in written.select("validation_run_id").distinct().collect()} == {"schedule-0", "schedule-1"}
    assert written.select("audit_id").distinct().count() == written.count()
    # reports read it like any history
    as_of = str(written.first()["run_date"])
    assert reports.daily_success_trend(written, as_of).agg(F.sum("total_validations")).first()[0] == written.count()


def test_two_scheduled_runs_are_two_runs_in_regressions(spark, tmp_path):
    incoming, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for code in ("CREATE TABLE t (a VARCHAR(3))", "x = 1"):
        books(spark, a=code).write.mode("append").parquet(incoming)
        jobs.scheduled_audit(spark.readStream.schema(CORPUS).parquet(incoming), out, progress).awaitTermination()
    changes = reports.regressions(store.load_findings(spark, out)).collect()
    assert {(r["rule"], r["change"], r["validation_run_id"]) for r in changes} >= {(fixed.LABEL_STRING_TYPES, "newly fixed", "schedule-1")}


def test_a_batch_delivered_again_adds_nothing(spark, tmp_path):
    """Files of a batch are there, but the run was not noted as done when the driver died."""
    import shutil

    incoming, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    books(spark, a="x", b="SELECT *").write.parquet(incoming)

    def run():
        jobs.scheduled_audit(spark.readStream.schema(CORPUS).parquet(incoming), out, progress).awaitTermination()
        return store.load_findings(spark, out).collect()

    first = run()
    shutil.rmtree(f"{progress}/commits")
    assert sorted(run()) == sorted(first)  # the ledger of runs knows it
    shutil.rmtree(f"{progress}/commits")
    open_ = shared.stored(jobs.runs_of(spark, out).filter("NOT done"), "begun")  # only that it was begun
    shutil.rmtree(f"{out}.runs")
    open_.write.parquet(f"{out}.runs")
    again = run()
    keys = ["audit_id", "validation_run_id", "validation_timestamp", "run_date", "details"]
    assert sorted(tuple(r[k] for k in keys) for r in again) == sorted(tuple(r[k] for k in keys) for r in first)


def test_streaming_trend(spark, tmp_path):
    """Repeats count once, late findings are dropped, open days are held back."""
    incoming, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    waves = [
        [("1", "2024-01-01 10:00:00", "Passed"), ("1", "2024-01-01 10:00:00", "Passed"), ("2", "2024-01-01 11:00:00", "Failed")],
        [("3", "2024-01-02 10:00:00", "Passed"), ("1", "2024-01-01 10:00:00", "Passed")],
        [("4", "2024-01-09 10:00:00", "Passed")],
        [("5", "2024-01-01 12:00:00", "Passed"), ("6", "2024-01-09 11:00:00", "Failed")],
    ]
    for wave in waves:
        rows = spark.createDataFrame(wave, "audit_id string, t string, status string")
        stamped = rows.select("audit_id", F.to_timestamp("t").alias("validation_timestamp"), "status").coalesce(1)
        stamped.write.mode("append").parquet(incoming)
        arriving = spark.readStream.schema(stamped.schema).parquet(incoming)
        jobs.run_trend(arriving, out, progress).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert sorted((str(r["date"]), r["total_validations"], r["passed"]) for r in found) == [("2024-01-01", 2, 1), ("2024-01-02", 1, 1)]


def test_a_rule_without_a_row_is_fixed_and_fails_again(spark):
    """Titles give rows only where they are missing."""
    schema = "notebook_path string, rule string, status string, run_date string"
    rows = [("a", "T", "Failed", "2024-01-01"), ("a", "L", "Passed", "2024-01-01"), ("a", "L", "Passed", "2024-01-02"), ("a", "T", "Failed", "2024-01-03"), ("b", "L", "Passed", "2024-01-02")]
    history = spark.createDataFrame(rows, schema).withColumn("run_date", F.to_date("run_date"))
    found = sorted((r["notebook_path"], r["rule"], str(r["run_date"]), r["change"]) for r in reports.regressions(history).collect())
    assert found == [("a", "T", "2024-01-02", "newly fixed"), ("a", "T", "2024-01-03", "newly failing")]
    # a run that looked at a notebook and found nothing at all is known by its roster only
    only = history.filter("rule = 'T'")
    assert reports.regressions(only).count() == 0
    roster = history.select("notebook_path", "run_date").distinct()
    assert reports.regressions(only, roster).count() == 2


def test_history_layout(spark, secret, tmp_path):
    location = str(tmp_path / "history")
    stamp = F.lit("2024-01-01 02:00:00").cast("timestamp")
    many = secret.repartition(8)
    for run in ("r1", "r2"):
        store.append_history(many, location, run, "test", stamp, audited=books(spark, a="x"))
    store.append_history(secret.withColumn("pr_number", F.lit(3)), location, "r3", "test", stamp)
    files = list((tmp_path / "history").glob("run_date=*/*.parquet"))
    assert len(files) == 3  # a day of a run is one file, whatever the number of tasks
    history = store.load_findings(spark, location)
    assert "pr_number" in history.columns and history.filter("pr_number = 3").count() == secret.count() and history.count() == 3 * secret.count()
    before = plain(history.select("audit_id", "details", "validation_run_id", "pr_number"))
    assert store.compact_history(spark, location) == ["2024-01-01"] and store.compact_history(spark, location) == []
    assert len(list((tmp_path / "history").glob("run_date=*/*.parquet"))) == 1
    assert plain(store.load_findings(spark, location).select("audit_id", "details", "validation_run_id", "pr_number")) == before
    assert sorted(r["validation_run_id"] for r in store.load_roster(spark, location).collect()) == ["r1", "r2"]
    with pytest.raises(ValueError, match="pr_number"):
        store.append_history(secret.withColumn("pr_number", F.lit("3")), location, "r4", "test", stamp)


def test_stored_runs_hold_no_secret(spark, tmp_path):
    found = engine.run_validation(books(spark, a='password = "hunter2"\nh = "Bearer abcdefgh"'))
    details = [r["details"] for r in found["findings"].collect()]
    assert not any("hunter2" in d or "abcdefgh" in d for d in details) and details.count(fixed.SECRET_FOUND + "***") == 2


def test_own_rules_are_governed_by_the_catalog(spark):
    from cellaudit.operators.catalog import Setting
    from cellaudit.operators.extend import python_rule, register_rule
    from cellaudit.operators.rules.base import failed, one, passed

    long = register_rule("long", "Long", lambda p: one(F.length("code") > p.get("most", 10), failed("long"), passed("short")))
    words = python_rule("words", "Words", lambda code, p: [("Failed" if w in code else "Passed", w) for w in p.get("words", [])])
    corpus = books(spark, a="SELECT * FROM t")

    def run(*settings):
        found = engine.validate(corpus, [*settings], extra=[long, words]).filter("rule_key IN ('long', 'words')").collect()
        return sorted((r["rule_key"], r["severity"], r["status"], r["details"]) for r in found)

    assert run() == [("long", "warning", "Failed", "long")]
    assert run(Setting("custom", "long", "Long", "error", parameters={"most": 100}), Setting("custom", "words", "Words", "info", parameters={"words": ["SELECT", "x"]})) == [
        ("long", "error", "Passed", "short"), ("words", "info", "Failed", "SELECT"), ("words", "info", "Passed", "x"),
    ]
    assert run(Setting("custom", "long", "Long", enabled=False)) == []
