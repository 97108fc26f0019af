"""One pass for all rules, and a store of answers that outlives runs."""

import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import code_cell, corpus, notebook

from cellaudit.functions import shared
from cellaudit.operators import audit, engine, responses, verdicts
from cellaudit.operators.catalog import DEFAULT_CATALOG, enable_rules
from cellaudit.operators.responses import ResponseStore
from cellaudit.sources import findings as store

BOOKS = [
    notebook(code_cell("x = 1", title="load")), notebook(code_cell("x = 1", title="load")), notebook(code_cell("df.cache()", title="a"), code_cell("y", title="b")),
    notebook({"cell_type": "code", "source": None}), "[]", notebook(code_cell("password = 'p'")), notebook(*[code_cell(f"c{i}", title=f"t{i}") for i in range(7)]),
]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_columns(df):
    """What the plan sorts, or aggregates by sorting."""
    return " ".join(line for line in physical(df).splitlines() if "Sort" in line)


def plain(df):
    return sorted(map(tuple, df.drop("audit_time").collect()), key=str)


class Model:
    """Counts calls across Python workers by files in a folder."""

    def __init__(self, folder, refused=()):
        self.folder, self.refused = str(folder), tuple(refused)

    def __call__(self, system, user):
        import os
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        if any(word in user for word in self.refused):
            raise RuntimeError("refused")
        return "1. True (fine)\n2. True (fine)"

    def calls(self):
        import os

        return len(os.listdir(self.folder))


@pytest.fixture
def model(tmp_path):
    (tmp_path / "calls").mkdir()
    return Model(tmp_path / "calls")


def test_one_pass_equals_three(spark):
    books = corpus(spark, BOOKS)
    whole = audit.open_audit(books, run_id="r", redact=False)
    assert plain(whole.findings()) == plain(engine.validate(books, run_id="r"))
    assert plain(audit.open_audit(books, run_id="r").findings()) == plain(store.redact_secrets(engine.validate(books, run_id="r")))
    asked = whole.requests()
    assert plain(asked) == plain(verdicts.all_requests(books))
    answers = asked.select("request_id", F.lit("1. True (x)\n2. False (y)").alias("content"), F.lit(None).cast("string").alias("error"))
    assert plain(whole.verdicts(answers)) == plain(verdicts.verdict_findings(books, answers, run_id="r"))
    assert whole.complete(answers).count() == whole.findings().count() + whole.verdicts(answers).count()
    assert whole.complete(answers).select("audit_id").distinct().count() == whole.complete(answers).count()


def test_other_catalogs_in_one_pass(spark):
    books = corpus(spark, BOOKS)
    for catalog in (
        [], enable_rules(DEFAULT_CATALOG, only=["valid_languages_only"]), enable_rules(DEFAULT_CATALOG, only=["cache_usage"]),
        enable_rules(DEFAULT_CATALOG, off=["descriptive_cell_titles"]), enable_rules(DEFAULT_CATALOG, only=["descriptive_cell_titles", "efficient_joins"]),
    ):
        whole = audit.open_audit(books, catalog, redact=False)
        assert plain(whole.findings()) == plain(engine.validate(books, catalog))
        nothing = spark.createDataFrame([], verdicts.RESPONSE_SCHEMA)
        found = whole.verdicts(nothing)
        assert {r["status"] for r in found.collect()} <= {"Pending"}
        assert found.count() == whole.links().count() + whole.title_links().select(F.sum(F.size("titles"))).first()[0] if whole.title_links().count() else True
        assert whole.requests().count() == whole.links().select("request_id").distinct().count() + whole.title_links().select("request_id").distinct().count()


def test_notebooks_are_read_once(spark):
    books = shared.stored(corpus(spark, BOOKS), "books")
    rows, slots = verdicts.tagged(books)
    assert plan(rows).count("from_json(StructField(whole notebook") == 1 and plan(rows).count("from_json(ArrayType(VariantType") == 1
    assert "Exchange" not in physical(rows) and "Python" not in physical(rows)
    whole = audit.open_audit(books)
    for kind in (whole.findings(), whole.links(), whole.title_links()):
        assert "from_json(StructField(whole notebook" not in plan(kind) and "PartitionFilters: [isnotnull(tag" in physical(kind)


def test_texts_are_fetched_late_and_never_sorted(spark):
    books = shared.stored(corpus(spark, BOOKS), "books")
    links = verdicts.request_links(books)
    text_columns = re.compile(r"(content|code|folded|user|cells|titles)#")
    assert "request_id#" in sorted_columns(verdicts.distinct_questions(links))
    for df in (verdicts.distinct_questions(links), verdicts.build_requests(books), verdicts.batch_title_prompts(books)):
        assert not text_columns.search(sorted_columns(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fetched = verdicts.build_requests(books)
        shown = physical(fetched)
        assert "ShuffledHashJoin" in shown and "SortMergeJoin" not in shown and not text_columns.search(sorted_columns(fetched))
        assert fetched.count() == verdicts.request_links(books).select("request_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_paths_and_copies_are_asked_about_once(spark):
    rows = [("a", BOOKS[0]), ("a", BOOKS[0]), ("a", BOOKS[2]), ("b", BOOKS[0]), ("b", BOOKS[2])]
    asked = verdicts.all_requests(spark.createDataFrame(rows, "path string, content string"))
    assert asked.count() == asked.select("request_id").distinct().count()
    links = verdicts.request_links(corpus(spark, [BOOKS[0], BOOKS[2]])).select("request_id").distinct()
    assert links.join(asked, "request_id", "left_anti").count() == 0
    # what is prepared as a table serves as well
    prepared = shared.stored(engine.prepared(corpus(spark, BOOKS)), "prepared")
    assert plain(verdicts.all_requests(prepared)) == plain(verdicts.all_requests(corpus(spark, BOOKS)))


def test_only_new_questions_are_asked(spark, tmp_path, model):
    kept = ResponseStore(spark, str(tmp_path / "store"))
    assert kept.answers().count() == 0 and kept.known().count() == 0
    first = audit.open_audit(corpus(spark, BOOKS[:3]))
    n = first.requests().count()
    found = first.ask(kept, model, 2)
    assert model.calls() == n and found.filter("status = 'Pending'").count() == 0
    assert plain(first.ask(kept, model, 2)) == plain(found) and model.calls() == n
    second = audit.open_audit(corpus(spark, BOOKS))
    new = second.requests(kept.known()).count()
    assert 0 < new < second.requests().count()
    second.ask(kept, model, 2)
    assert model.calls() == n + new == kept.answers().count() == kept.rows().count()
    assert second.requests(kept.known()).count() == 0


def test_a_run_that_dies_loses_only_its_open_slice(spark, tmp_path, model, monkeypatch):
    requests = spark.range(60).select(F.sha2(F.col("id").cast("string"), 256).alias("request_id"), F.lit("s").alias("system"), F.col("id").cast("string").alias("user"))
    kept = ResponseStore(spark, str(tmp_path / "store"))
    committed, commit = [], ResponseStore._commit

    def dying(self, *given):
        if len(committed) == 2:
            raise KeyboardInterrupt
        commit(self, *given)
        committed.append(given[3])

    monkeypatch.setattr(ResponseStore, "_commit", dying)
    with pytest.raises(KeyboardInterrupt):
        kept.score(requests, model, 2, per_task=5)  # six slices; the third is scored but never complete
    done, before = kept.known().count(), model.calls()
    assert done == sum(committed) > 0 and before > done
    monkeypatch.setattr(ResponseStore, "_commit", commit)
    again = ResponseStore(spark, str(tmp_path / "store"))
    assert again.score(requests, model, 2, per_task=5).count() == 60
    assert model.calls() == before + 60 - done
    assert again.rows().count() == 60


def test_many_questions_make_larger_slices(spark, tmp_path, model, monkeypatch):
    monkeypatch.setattr(responses, "MOST_SLICES", 3, raising=False)
    requests = spark.range(60).select(F.sha2(F.col("id").cast("string"), 256).alias("request_id"), F.lit("s").alias("system"), F.col("id").cast("string").alias("user"))
    kept = ResponseStore(spark, str(tmp_path / "store"))
    assert kept.score(requests, model, 2, per_task=1).count() == 60 == model.calls() == kept.rows().count()
    assert kept.slices().count() == 3


def test_answers_without_a_store_are_asked_in_rounds_of_bounded_text(spark, model, monkeypatch):
    monkeypatch.setattr(responses, "TASK_BYTES", 200, raising=False)
    requests = spark.range(60).select(F.col("id").cast("string").alias("request_id"), F.lit("s").alias("system"), F.lit("x" * 40).alias("user"))
    scored = verdicts.score_requests(requests, model, 2)
    assert sorted(int(r["request_id"]) for r in scored.collect()) == list(range(60)) and model.calls() == 60
    # a file for each task of each round: 2,460 bytes are seven rounds of two tasks
    assert 7 <= len(scored.inputFiles()) <= 14
    empty = verdicts.score_requests(requests.limit(0), model, 2)
    assert empty.count() == 0 and empty.columns == ["request_id", "content", "error"]


def test_errors_can_be_asked_again(spark, tmp_path, model):
    requests = spark.createDataFrame([(str(i), "s", u) for i, u in enumerate(["fine", "bad", "fine too"])], verdicts.REQUEST_SCHEMA)
    kept = ResponseStore(spark, str(tmp_path / "store"))
    refusing = Model(model.folder, ["bad"])
    assert {r["request_id"]: r["error"] for r in kept.score(requests, refusing, 1).collect()} == {"0": None, "1": "refused", "2": None}
    assert kept.score(requests, model, 1).filter("error IS NOT NULL").count() == 1 and model.calls() == 3
    assert kept.score(requests, model, 1, retry_errors=True).filter("error IS NOT NULL").count() == 0 and model.calls() == 4
    assert kept.rows().count() == 4 and kept.answers().count() == 3
    before = plain(kept.answers())
    kept.compact()
    assert plain(kept.answers()) == before and kept.slices().count() == 1 and kept.rows().count() == 3
    assert verdicts.score_requests(requests, model, 1, kept).count() == 3 and model.calls() == 4
