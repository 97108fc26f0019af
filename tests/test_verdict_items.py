"""Cases found in review: trailing text, long words, days, runs, file names, versions."""

import datetime
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from cellaudit.functions import fixed, text
from cellaudit.operators import engine, incremental
from cellaudit.operators.catalog import DEFAULT_CATALOG, attach_severity, enable_rules, read_catalog, rule_catalog, rules_version
from cellaudit.operators.extend import register_rule
from cellaudit.operators.rules import performance, quality
from cellaudit.operators.rules.base import failed, one, passed
from cellaudit.plans import reports
from cellaudit.sources import findings as store
from cellaudit.sources import notebooks

GOOD = '{"cells":[{"cell_type":"code","source":["x"]}]}'


@pytest.mark.parametrize(
    ("content", "readable"),
    [
        (GOOD, True), (f" \n{GOOD}\t", True), ("{}", True), (GOOD + '{"cells":[]}', False), (GOOD + " junk }", False),
        (GOOD + ",{}", False), (GOOD + "] }", False), (GOOD + ",[1] }", False), ("", False), (None, False), ("[{}]", False), ("{}}", False), ("{", False),
    ],
)
def test_text_after_the_object(spark, content, readable):
    row = notebooks.parse_notebooks(spark.createDataFrame([("/a", content)], "path string, content string")).first()
    assert bool(row.readable) == readable


BODIES = [
    "CREATE TABLE a (x INT, y STRING NOT NULL)", "create table a x ( create table b (y INT)", "CREATE TABLE CREATE TABLE a (x INTEGER STRING)",
    "CREATE TABLE a () CREATE TABLE b (z DATE", "CREATE TABLE a (x INTEGER STRING, aSTRING INT)", "(CREATE TABLE", "é INT ñ STRING notnull x DECIMAL  NOT NULL",
]
VIEWS = [
    "CREATE VIEW v AS SELECT * FROM a; CREATE VIEW w AS SELECT b", "create temporary view v as (select 1) CREATE VIEW vas SELECT 2",
    "CREATE VIEW CREATE VIEW x AS SELECT 1", "CREATE VIEW v CREATE VIEW w", "CREATE VIEW vAS SELECT 3 AS SELECT 4", "CREATE VIEW  AS SELECT 5", "CREATE VIEW a\nAS\n SELECT *",
]


def plain(pattern, texts, flags, group=1):
    return [[m.group(group) or "" for m in re.finditer(pattern, t, flags)] for t in texts]


def test_linear_forms_find_the_same(spark):
    bodies = spark.createDataFrame([(i, t) for i, t in enumerate(BODIES)], "i int, code string").orderBy("i")
    for group in (1, 2, 3):
        found = [r[0] for r in bodies.select(text.find_all(F.col("code"), quality.TABLE_COLUMN, group)).collect()]
        assert found == plain(fixed.TABLE_COLUMN, BODIES, re.IGNORECASE, group)
    found = [[b for b in r[0] if b] for r in bodies.select(text.find_all(F.col("code"), quality.TABLE_BODY, 1, dotall=True)).collect()]
    assert found == [[b for b in f if b] for f in plain(fixed.TABLE_BODY, BODIES, re.IGNORECASE | re.DOTALL)]
    views = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(VIEWS)], "i int, folded string").orderBy("i")
    pattern = F.lit(text.folded_regex(performance.VIEW_BODY, dotall=True))
    found = [[b for b in r[0] if b] for r in views.select(F.regexp_extract_all("folded", pattern, F.lit(1))).collect()]
    want = plain(fixed.VIEW_BODY, [v.lower() for v in VIEWS], re.IGNORECASE | re.DOTALL)
    assert [[b.strip() for b in f] for f in found] == [[b.strip() for b in f] for f in want]


def test_long_texts_are_searched_in_time(spark):
    code = ["CREATE TABLE t (" + "x" * 100_000 + ")", "CREATE TABLE t\n" * 50_000, "CREATE VIEW v\n" * 50_000, "CREATE TABLE t (" * 20_000]
    cells = [("/%d" % i, '{"cells":[{"cell_type":"code","source":["%s"]}]}' % c.replace("\n", "\\n")) for i, c in enumerate(code)]
    catalog = enable_rules(DEFAULT_CATALOG, only=["column_nullability", "views_explicit_columns"])
    start = time.monotonic()
    assert engine.validate(spark.createDataFrame(cells, "path string, content string"), catalog).count() >= 0
    assert time.monotonic() - start < 60


def history(spark, rows):
    schema = "notebook_path string, rule string, status string, t string, validation_run_id string"
    zone = F.current_timezone()
    stamp = F.from_utc_timestamp(F.to_timestamp_ntz("t").cast("timestamp"), zone)
    return spark.createDataFrame(rows, schema).withColumn("validation_timestamp", stamp).drop("t")


def test_days_are_utc(spark, tmp_path):
    rows = [("/a", "r", "Passed", "2024-01-01 02:00:00", "1"), ("/a", "r", "Failed", "2024-01-31 23:30:00", "2"), ("/a", "r", "Failed", "2024-02-01 00:30:00", "3"), ("/a", "r", "Failed", "2023-12-31 23:30:00", "0")]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        found = history(spark, rows).withColumn("details", F.lit(""))
        store.append_history(found, str(tmp_path / "h"), "x", "y", F.col("validation_timestamp"))
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        trend = reports.daily_success_trend(store.load_findings(spark, str(tmp_path / "h")), "2024-01-31")
        assert [(r.date, r.total_validations) for r in trend.collect()] == [(datetime.date(2024, 1, 31), 1), (datetime.date(2024, 1, 1), 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_runs_of_one_day(spark):
    rows = [("/a", "r", "Failed", "2024-01-01 08:00:00", "z"), ("/a", "r", "Passed", "2024-01-01 18:00:00", "a"), ("/a", "r", "Passed", "2024-01-02 08:00:00", "m")]
    out = reports.regressions(history(spark, rows)).collect()
    assert [(r.validation_run_id, str(r.run_date), r.change) for r in out] == [("a", "2024-01-01", "newly fixed")]


def test_findings_keep_what_they_say(spark):
    found = engine.validate(spark.createDataFrame([("/a", "no json"), ("/b", '{"cells":{}}')], "path string, content string"))
    graded = attach_severity(found, rule_catalog(spark))
    assert graded.where("severity IS NULL").count() == 0 and sorted(graded.columns) == sorted(found.columns)
    by_domain = {r.domain: r.failures for r in reports.failures_by_category(found, rule_catalog(spark)).collect()}
    assert by_domain[None] == 1 and len(by_domain) == 5


def test_payload_of_an_empty_run(spark):
    empty = engine.validate(spark.createDataFrame([], "path string, content string"))
    payload = reports.monitoring_payload(empty).collect()
    assert [r.payload for r in payload] == ['{"total_results":0,"passed_results":0,"failed_results":0,"pending_results":0,"pass_rate":0.0,"rule_summary":{}}']


def test_all_notebooks_tie(spark):
    rows = [(f"/{i}", d, "Failed") for i in range(300) for d in ("A", None)]
    out = reports.top_offenders_by_domain(spark.createDataFrame(rows, "notebook_path string, domain string, status string"), 3)
    assert out.count() == 600 and {r["rank"] for r in out.collect()} == {1}


def test_file_names(spark, tmp_path):
    root = tmp_path / "nb"
    for name in ("my dir/a b", "a+b", "100%", "nb/x", "nb/nb/x", "x"):
        path = root / f"{name}.ipynb"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(GOOD)
    want = {"/my dir/a b", "/a+b", "/100%", "/nb/x", "/nb/nb/x", "/x"}
    for location in (str(root), f"{root}/", f"file://{root}", f"file:{root}", os.path.relpath(root)):
        assert {r.path for r in notebooks.load_notebook_files(spark, location).collect()} == want
    several = notebooks.load_notebook_files(spark, f"{root}/my dir", f"file://{root}/n*")
    assert sorted(r.path for r in several.collect()) == ["/a b", "/nb/x", "/x"]
    assert [r.path for r in notebooks.load_notebook_files(spark, f"{root}/{{nb,none}}/nb").collect()] == ["/x"]
    with pytest.raises(ValueError):
        notebooks.load_notebook_files(spark)


def test_version_ignores_order(spark):
    turned = read_catalog(rule_catalog(spark, list(reversed(DEFAULT_CATALOG))))
    assert rules_version(turned) == rules_version(DEFAULT_CATALOG)


def test_own_rules_reach_incremental_audits(spark):
    own = register_rule("own", "Own rule", lambda: one(F.contains(F.col("code"), F.lit("x")), passed("has x"), failed("no x")), fixed.GOVERNANCE)
    assert rules_version(DEFAULT_CATALOG, [own]) != rules_version(DEFAULT_CATALOG)
    corpus = spark.createDataFrame([("/a", GOOD), ("/b", GOOD.replace('"x"', '"y"'))], "path string, content string")
    before = incremental.snapshot(corpus.where("path = '/a'"), extra=[own])
    found = engine.validate(corpus.where("path = '/a'"), extra=[own])
    reused = incremental.reuse_unchanged(corpus, before, found, extra=[own])
    shown = ["notebook_path", "rule", "status", "details"]
    assert sorted(reused.select(shown).collect()) == sorted(engine.validate(corpus, extra=[own]).select(shown).collect())
    requested = spark.createDataFrame([("/a",)], "path string")
    assert engine.validate_requested(corpus, requested, extra=[own]).where("rule = 'Own rule'").count() == 1
