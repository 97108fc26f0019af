"""Findings as a whole: order, errors, switches, plans."""

import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import code_cell, corpus, findings, notebook

from cellaudit.functions import fixed, shared
from cellaudit.operators import counts, engine, extend, summary
from cellaudit.operators.catalog import DEFAULT_CATALOG, Setting, attach_severity, enable_rules, read_catalog, rule_catalog, rules_version
from cellaudit.operators.rules import failed, passed
from workload.fixture import corpus as made_corpus


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    return shared.stored(made_corpus(spark, sf_dir), "corpus")


def rows_of(df):
    return sorted(map(tuple, df.drop("audit_time").collect()), key=str)


def errors(spark, contents, **switch):
    catalog = enable_rules(DEFAULT_CATALOG, **switch)
    found = engine.validate(corpus(spark, contents), catalog).filter("rule_key = 'domain_error'")
    return sorted((int(r["notebook_path"]), r["domain"], r["details"].removeprefix(fixed.DOMAIN_ERROR_PREFIX)) for r in found.collect())


ALL = sorted([fixed.CODE_QUALITY, fixed.PERFORMANCE, fixed.SECURITY, fixed.GOVERNANCE])


def test_domain_errors(spark):
    header, null_source = {"cell_type": "markdown", "source": ["# header"]}, {"cell_type": "markdown", "source": None}
    books = [
        notebook(code_cell("x", title=None)),  # titles are read by one domain only
        notebook({"cell_type": "code", "source": None}),  # code is read by all
        notebook(header, null_source),  # not read: the header came first
        notebook(null_source, header),
        notebook({"cell_type": "markdown", "title": None, "source": []}),  # only titles of code cells are read
        notebook(code_cell("x"), code_cell("x"), null_source),  # beyond the head
        '{"cells": null}',
        '{"cells": [1]}',
    ]
    shape = "cells is not a list of cells"
    assert errors(spark, books) == sorted(
        [(0, fixed.CODE_QUALITY, fixed.NULL_TITLE)]
        + [(1, d, fixed.NULL_SOURCE) for d in ALL]
        + [(3, fixed.CODE_QUALITY, fixed.NULL_SOURCE)]
        + [(6, d, shape) for d in ALL]
        + [(7, d, shape) for d in ALL]
    )


def test_errors_need_a_rule_that_reads(spark):
    books = [notebook(code_cell("x", title=None)), notebook({"cell_type": "code", "source": None})]
    assert errors(spark, books, only=["valid_languages_only"]) == []
    assert errors(spark, books, only=["avoid_select_star"]) == [(1, fixed.PERFORMANCE, fixed.NULL_SOURCE)]
    # a rule only a model decides reads the code as well
    assert errors(spark, books, only=["efficient_joins"]) == [(1, fixed.PERFORMANCE, fixed.NULL_SOURCE)]


def test_a_domain_in_error_has_no_other_findings(spark):
    found = engine.validate(corpus(spark, [notebook({"cell_type": "code", "source": None})])).collect()
    assert sorted(r["rule"] for r in found) == sorted(f"{name} Error" for d, name in fixed.DOMAIN_NAMES.items() if d != fixed.CUSTOM)


def test_unreadable_notebook_has_one_finding(spark):
    (row,) = engine.validate(corpus(spark, ["[]"])).collect()
    assert (row["rule"], row["status"]) == (fixed.ACCESS_LABEL, "Failed")
    assert row["details"] == "Failed to process notebook 0: Failed to create metadata from content for 0"


def test_unlisted_rules_are_off(spark):
    book = corpus(spark, [notebook(code_cell("CREATE VIEW v AS SELECT * FROM a"))])
    assert engine.validate(book, []).count() == 0
    labels = {r["rule"] for r in engine.validate(book).collect()}
    assert fixed.LABEL_VIEWS not in labels and fixed.LABEL_ISOLATION not in labels


def test_severity_is_checked():
    with pytest.raises(ValueError):
        Setting(fixed.SECURITY, "x", "X", "fatal")


def test_catalog_round_trip(spark):
    assert read_catalog(rule_catalog(spark)) == DEFAULT_CATALOG
    changed = enable_rules(DEFAULT_CATALOG, parameters={"metadata_tagging": {"required_tags": ["a"]}})
    assert rules_version(changed) != rules_version(DEFAULT_CATALOG)
    off = enable_rules(DEFAULT_CATALOG, parameters={"data_isolation": {"unused": 1}})
    assert rules_version(off) == rules_version(DEFAULT_CATALOG)


def test_ids_are_repeatable_and_distinct(stored):
    first, again = (engine.validate(stored, run_id="r").select("audit_id").collect() for _ in range(2))
    assert sorted(first) == sorted(again)
    assert len(set(first)) == len(first)
    other = engine.validate(stored, run_id="s").select("audit_id").collect()
    assert not set(first) & set(other)


def test_partitioning_does_not_matter(stored):
    everything = rows_of(engine.validate(stored))
    assert rows_of(engine.validate(stored.repartition(13))) == everything
    assert rows_of(engine.validate(stored.coalesce(1))) == everything


def test_evaluation_is_one_narrow_stage(stored):
    plan = plan_of(engine.validate(stored))
    operators = set(re.findall(r"^[\s:+-]*(?:\*\(\d+\) )?([A-Z]\w+)", plan, re.MULTILINE))
    assert {"Generate", "Project"} <= operators
    assert not [o for o in operators if "Exchange" in o or "Join" in o or "Python" in o], operators


def test_code_is_put_together_once(stored):
    plan = engine.validate(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS code#") == 1 and plan.count("AS folded#") == 1
    # once in the usual way, once for notebooks of another shape
    assert plan.count("from_json(StructField(whole notebook") == 1 and plan.count("from_json(ArrayType(VariantType") == 1


def test_summary_reads_no_details(stored):
    """Texts are dropped before the shuffle."""
    plan = plan_of(summary.summary_by_rule(engine.validate(stored)))
    assert plan.count("Exchange") == 1 and "hashpartitioning(rule" in plan


def test_cube_slices_are_the_summaries(stored):
    found = shared.stored(engine.validate(stored), "findings")
    cube = summary.summary_cube(found)
    counts = ["passed", "failed", "pending"]
    by_rule = cube.filter("level = 'rule'").select("rule", *counts)
    by_notebook = cube.filter("level = 'notebook'").select("notebook_path", *counts)
    assert rows_of(by_rule) == rows_of(summary.summary_by_rule(found))
    assert rows_of(by_notebook) == rows_of(summary.summary_by_notebook(found))
    total = summary.summary_total(found).first()
    assert tuple(cube.filter("level = 'total'").select(*counts).first()) == tuple(total[f"{c}_results"] for c in counts)
    assert sum(total[f"{c}_results"] for c in counts) == total["total_results"] == found.count()


def test_empty_summary(spark):
    empty = engine.validate(corpus(spark, []))
    total = summary.summary_total(empty).first()
    assert (total["total_results"], total["pass_rate"]) == (0, 0.0)
    assert empty.columns == engine.FINDING_COLUMNS
    assert summary.batch_run_summary(empty).first()["total_notebooks"] == 0


def test_own_rules(spark):
    books = corpus(spark, [notebook(code_cell("abc")), notebook(code_cell("a" * 20))])
    long = F.length("code") > 10
    column_rule = extend.register_rule("long", "Long", lambda: F.array(F.when(long, failed("long")).otherwise(passed("short"))))
    python_rule = extend.python_rule("vowels", "Vowels", lambda code: [("Failed", c) for c in code if c in "e"] or [("Passed", "none")])
    found = engine.validate(books, extra=[column_rule, python_rule]).filter(F.col("domain") == fixed.CUSTOM)
    assert sorted((r["notebook_path"], r["rule"], r["status"], r["details"]) for r in found.collect()) == [
        ("0", "Long", "Passed", "short"), ("0", "Vowels", "Passed", "none"), ("1", "Long", "Failed", "long"), ("1", "Vowels", "Passed", "none"),
    ]


def test_custom_patterns(spark):
    book = notebook(code_cell("CREATE TABLE prod_a (Id INT, name STRING) -- masked"))
    row = Setting(
        fixed.CUSTOM, "naming", "Naming", "info",
        parameters={"patterns": {"table_names": "^(prod|dev)_.*", "column_names": "^[A-Z]\\w*$"}, "require_encryption_keywords": ["MASKED"], "disallowed_functions": ["DESCRIBE"]},
    )
    found = engine.validate(corpus(spark, [book]), [row]).orderBy("seq").collect()
    assert [(r["status"], r["severity"]) for r in found] == [(s, "info") for s in ("Passed", "Passed", "Failed", "Passed", "Passed")]


def test_quality_gate(spark):
    rows = [(1, "Failed", "warning"), (1, "Passed", "error"), (2, "Failed", "error"), (3, "Passed", "error")]
    found = spark.createDataFrame(rows, "pr int, status string, severity string")
    gates = {r["pr"]: r["exit_code"] for r in summary.quality_gate(found, ["pr"]).collect()}
    assert gates == {1: 1, 2: 1, 3: 0}
    gates = {r["pr"]: r["gate_open"] for r in summary.quality_gate(found, ["pr"], "error").collect()}
    assert gates == {1: True, 2: False, 3: True}


def test_findings_do_not_move_to_meet_the_catalog(spark, stored):
    """A rule may hold a large share of all findings; they are not shuffled by rule."""
    plan = plan_of(attach_severity(engine.validate(stored), rule_catalog(spark)))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_parsed_notebooks_can_be_stored(stored):
    """Parsing once for several audits gives the same findings."""
    books = shared.stored(engine.prepared(stored), "books")
    assert rows_of(engine.validate(books)) == rows_of(engine.validate(stored))


def test_listing_order(spark):
    book = notebook(code_cell("SELECT *\nselect *\nCREATE TABLE t (a INT, b DATE)"))
    found = engine.validate(corpus(spark, [book, "[]"]), run_id="r")
    listed = engine.in_order(found).collect()
    assert [r["rule"] for r in listed if r["notebook_path"] == "0"] == [
        fixed.LABEL_LANGUAGES, fixed.LABEL_HEADER, fixed.LABEL_TITLE, fixed.LABEL_STRING_TYPES, fixed.LABEL_NULLABILITY, fixed.LABEL_NULLABILITY,
        fixed.LABEL_SELECT_STAR, fixed.LABEL_SELECT_STAR, fixed.LABEL_VECTORIZATION, fixed.LABEL_ACCESS_CONTROLS, fixed.LABEL_CATALOG,
        fixed.LABEL_COMMENTS, fixed.LABEL_TAGGING,
    ]
    assert [r["seq"] for r in listed if r["rule"] == fixed.LABEL_NULLABILITY] == [0, 1]
    names = [f"{name} Error" for domain, name in fixed.DOMAIN_NAMES.items() if domain != fixed.CUSTOM]
    assert set(names) <= set(fixed.LABEL_ORDER)


def test_counts_equal_the_summaries_of_findings(spark, stored):
    found = engine.validate(stored)
    for whole in (counts.counted(stored), counts.counted(stored).stored()):
        for a, b in (
            (whole.by_rule(), summary.summary_by_rule(found)), (whole.by_notebook(), summary.summary_by_notebook(found)),
            (whole.total(), summary.summary_total(found)), (whole.cube(), summary.summary_cube(found)),
        ):
            assert a.columns == b.columns and sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    plan = plan_of(counts.counted(stored).by_rule())
    assert "Generate" not in plan and "Expand" in plan
    # notebooks that were requested more often than once
    twice = stored.withColumn("copies", F.lit(2).cast("long"))
    assert sorted(counts.counted(twice).by_rule().collect()) == sorted(summary.summary_by_rule(engine.validate(twice)).collect())
    nothing = counts.counted(stored.limit(0))
    assert nothing.by_rule().count() == 0 and tuple(nothing.total().first()) == tuple(summary.summary_total(found.limit(0)).first())
