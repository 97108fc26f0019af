"""Questions to a model, and what is made of the answers."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import code_cell, corpus, notebook

from cellaudit.functions import fixed
from cellaudit.operators import verdicts
from cellaudit.operators.catalog import DEFAULT_CATALOG, enable_rules


def answers(spark, rows):
    return spark.createDataFrame(rows, verdicts.RESPONSE_SCHEMA)


def read(spark, reader, contents):
    rows = answers(spark, [(str(i), *c) if isinstance(c, tuple) else (str(i), c, None) for i, c in enumerate(contents)])
    found = rows.select("request_id", reader.alias("r")).collect()
    return [(r["r"]["status"], r["r"]["details"]) for r in sorted(found, key=lambda r: int(r["request_id"]))]


def test_contains_true(spark):
    found = read(spark, verdicts.verdict_contains_true(), ["It is True.", "true", (None, "timeout"), (None, None)])
    assert found == [("Passed", "It is True."), ("Failed", "true"), ("Failed", "LLM error: timeout"), ("Pending", fixed.UNANSWERED)]


def test_pattern(spark):
    contents = ["True (ok (fine)) x", "so: False\n (bad)", "true (x)", "True ()", "False (a\nb) True (c)", "no", (None, "e")]
    found = read(spark, verdicts.verdict_pattern("none", "error"), contents)
    assert found == [
        ("Passed", "ok (fine)"), ("Failed", "bad"), ("Failed", "none"), ("Passed", ""), ("Passed", "c"), ("Failed", "none"), ("Failed", "error"),
    ]


def test_injection(spark):
    contents = [
        "True, the code is secure", "SQL Injection Analysis: True", "secure from sql injection", "safe sql", "safe", "False: sql injection",
        "secure from SQL injection, not vulnerable to sql injection", "true secure but false, vulnerable", "True",
    ]
    assert [s[0] for s, _ in read(spark, verdicts.verdict_injection(), contents)] == list("PPPPFFFFF")


@pytest.mark.parametrize(
    "content, expected",
    [
        ("1. True (good)\n2. False (bad)", [(True, "(good)"), (False, "(bad)")]),
        ("\n\n 1. TRUE \r\n\x0b2. xtruex", [(True, ""), (True, "")]),
        ("yes", [(False, fixed.VERDICT_PARSE_ERROR)]),
        ("1.  True (two)", [(False, "True (two)")]),
        ("a b c d", [(False, "c d")]),
        ("", []),
        ("1. true  2. false\x852. true", [(True, ""), (False, ""), (True, "")]),
    ],
)
def test_title_lines(spark, content, expected):
    df = spark.createDataFrame([(content,)], "c string")
    (row,) = df.select(verdicts.parse_title_verdicts(F.col("c")).alias("v")).collect()
    assert [tuple(v) for v in row["v"]] == expected
    # the same by Python's own splitting
    plain = [line.strip().split(" ", 2) for line in content.strip().splitlines() if line.strip()]
    assert [("true" in p[1].lower()) if len(p) > 1 else False for p in plain] == [v for v, _ in expected]


def test_titles_are_matched_by_position(spark):
    """A short answer shifts the following batches; surplus lines are dropped."""
    titles = [f"t{i}" for i in range(12)]
    books = corpus(spark, [notebook(*[code_cell("x", title=f" {t} ") for t in titles], code_cell("y"))])
    links = verdicts.title_links(books)
    ids = {r["batch"]: r["request_id"] for r in links.collect()}
    assert sorted(ids) == [0, 1, 2]
    rows = [
        (ids[0], "\n".join(f"{i}. True (a{i})" for i in range(1, 5)), None),  # one line short
        (ids[1], None, "timeout"),
        (ids[2], "\n".join(f"{i}. False b{i}" for i in range(1, 9)), None),  # too many
    ]
    found = sorted(verdicts.title_verdicts(links, answers(spark, rows)).collect(), key=lambda r: r["seq"])
    assert [r["title"] for r in found] == titles
    assert [r["status"][0] for r in found] == list("PPPP" + "FFFFF" + "FFF")
    assert found[4]["details"] == "Title 't4': LLM error: timeout"
    assert found[9]["details"] == "Title 't9': b1"
    pending = verdicts.title_verdicts(links, answers(spark, []))
    assert pending.filter("status = 'Pending'").count() == 12


def test_short_answers_leave_titles_without_a_row(spark):
    books = corpus(spark, [notebook(code_cell("x", title="a"), code_cell("x", title="b"))])
    links = verdicts.title_links(books)
    found = verdicts.title_verdicts(links, answers(spark, [(links.first()["request_id"], "1. True", None)])).collect()
    assert [(r["title"], r["status"]) for r in found] == [("a", "Passed")]


def test_prompt(spark):
    links = verdicts.title_links(corpus(spark, [notebook(*[code_cell("x", title=f"t{i}") for i in range(6)])]))
    prompts = {r["batch"]: r["system"] for r in links.collect()}
    assert prompts[0] == fixed.PROMPT_TITLES + "1. t0\n2. t1\n3. t2\n4. t3\n5. t4\n"
    assert prompts[1] == fixed.PROMPT_TITLES + "1. t5\n"


def test_only_undecided_code_is_asked_about_and_copies_once(spark):
    plain, cached = notebook(code_cell("x = 1")), notebook(code_cell("df.cache()  # dapi1 partitioned by"))
    broken, untitled = notebook({"cell_type": "code", "source": None}), notebook(code_cell("x = 1", title=None))
    books = corpus(spark, [plain, plain, cached, broken, untitled, "[]"])
    links = verdicts.request_links(books).groupBy("path").agg(F.collect_set("rule_key").alias("keys")).collect()
    keys = {r["path"]: set(r["keys"]) for r in links}
    everything = {rule.rule_key for rule in verdicts.VERDICT_RULES}
    assert keys == {
        "0": everything, "1": everything, "4": everything - {"notebook_idempotency"},
        "2": {"notebook_idempotency", "efficient_joins", "sql_injection_risks"},
    }
    asked = verdicts.build_requests(books)
    assert asked.count() == asked.select("request_id").distinct().count() == 9
    # every link has its question
    assert verdicts.request_links(books).join(asked, "request_id", "left_anti").count() == 0


def test_rules_with_one_prompt_share_a_question(spark):
    same = {"llm_prompt": "same"}
    catalog = enable_rules(
        DEFAULT_CATALOG, only=["cache_usage", "no_hard_coded_secrets"], parameters={"cache_usage": same, "no_hard_coded_secrets": same}
    )
    books = corpus(spark, [notebook(code_cell("x"))])
    assert verdicts.build_requests(books, catalog).count() == 1
    assert verdicts.request_links(books, catalog).count() == 2


def test_scoring_turns_exceptions_into_data(spark):
    def model(system, user):
        if "boom" in user:
            raise RuntimeError("boom")
        return f"True ({len(user)})"

    books = corpus(spark, [notebook(code_cell("x")), notebook(code_cell("boom"))])
    asked = verdicts.all_requests(books)
    scored = verdicts.score_requests(asked, model, 3)
    assert scored.count() == asked.count()
    assert {r["error"] for r in scored.collect()} == {None, "boom"}
    found = verdicts.verdict_findings(books, scored)
    assert found.filter("status = 'Pending'").count() == 0
    details = {(r["notebook_path"], r["rule"]): (r["status"], r["details"]) for r in found.collect()}
    assert details["0", fixed.LABEL_CACHE] == ("Passed", "1")
    assert details["1", fixed.LABEL_SECRETS] == ("Failed", fixed.SECRET_ERROR)
    assert details["1", fixed.LABEL_JOINS] == ("Failed", "LLM error: boom")


def test_titles_are_not_asked_about_when_their_rule_is_off(spark):
    books = corpus(spark, [notebook(code_cell("x", title="a"))])
    off = enable_rules(DEFAULT_CATALOG, off=["descriptive_cell_titles"])
    assert verdicts.title_links(books, off).count() == 0
    assert verdicts.title_links(books, []).count() == 0


def test_a_question_shared_by_many_copies_is_split(spark):
    """The skewed side of the verdict join is narrow, and adaptive execution splits it."""
    rows = 60_000
    hot = spark.range(rows).select(
        F.concat(F.lit("/copy/"), F.col("id").cast("string")).alias("path"), F.lit("efficient_joins").alias("rule_key"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("request_id"),
    )
    links = hot.repartition(4)
    stored = spark.range(rows).select(F.col("id").cast("string").alias("request_id"), F.lit("True").alias("content"), F.lit(None).cast("string").alias("error"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name) for name in settings if spark.conf.get(name, None) is not None}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = verdicts.join_verdicts(links, stored)
        assert len(found.collect()) == rows
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.set(name, before[name]) if name in before else spark.conf.unset(name)
