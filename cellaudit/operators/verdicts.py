"""Rules a text model decides, as tables of requests, responses and verdicts.

The model call itself is the caller's function or service.  Around it:

* ``tagged`` says in one pass which notebook needs which answer, beside the findings
  of the text rules; its rows are narrow.
* ``build_requests`` holds every distinct question once, with its text, so copies
  of a notebook are asked about once.  Questions are compared by their ids; texts are
  fetched afterwards, for those that have no answer yet.
* responses are joined back on ``request_id``.  The text never takes part in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, shared, text
from ..functions.rows import kept
from . import responses as scoring
from .catalog import DEFAULT_CATALOG, Setting
from .cells import code_cells
from .engine import FINDING, QUESTION, TITLES_ASKED, Question, active_rules, copies_of, evaluated, identified, prepared
from .responses import SCHEMA as RESPONSE_SCHEMA
from .responses import ResponseStore, answered_by
from .rules.base import ROW, Rule, failed, passed
from .rules.quality import title_of

REQUEST_SCHEMA = "request_id string, system string, user string"


# ---- reading an answer: MDL4, MDL5, MDL6 ------------------------------------------
def _or_error(verdict: Column, error_details: Column) -> Column:
    """An error counts as failed; no answer yet is pending."""
    pending = F.struct(F.lit(fixed.PENDING).alias("status"), F.lit(fixed.UNANSWERED).alias("details"))
    return (
        F.when(F.col("error").isNotNull(), failed(error_details))
        .when(F.col("content").isNull(), pending)
        .otherwise(verdict)
    )


def _error_text() -> Column:
    return F.concat(F.lit(fixed.VERDICT_ERROR), F.col("error"))


def contains_true(content: Column) -> Column:
    return F.contains(content, F.lit("True"))


def verdict_contains_true() -> Column:
    content = F.col("content")
    return _or_error(F.when(contains_true(content), passed(content)).otherwise(failed(content)), _error_text())


def verdict_pattern(no_match: str, on_error: str) -> Column:
    """``True (why)`` or ``False (why)`` anywhere in the answer, case exact."""
    content = text.strip(F.col("content"))
    pattern = text.java_regex(fixed.VERDICT, ignore_case=False)
    why = F.regexp_extract(content, pattern, 2)
    verdict = (
        F.when(~content.rlike(pattern), failed(no_match))
        .when(F.regexp_extract(content, pattern, 1) == "True", passed(why))
        .otherwise(failed(why))
    )
    return _or_error(verdict, F.lit(on_error))


def _matches_any(folded: Column, table: list[tuple[list[str], list[str]]]) -> Column:
    def row(all_of: list[str], any_of: list[str]) -> Column:
        test = text.contains_any(folded, any_of) if any_of else F.lit(True)
        for word in all_of:
            test = test & F.contains(folded, F.lit(word))
        return test

    result = F.lit(False)
    for all_of, any_of in table:
        result = result | row(all_of, any_of)
    return result


def verdict_injection() -> Column:
    content = F.col("content")
    folded = F.lower(content)
    secure = _matches_any(folded, fixed.SECURE) & ~_matches_any(folded, fixed.VULNERABLE)
    return _or_error(F.when(secure, passed(content)).otherwise(failed(content)), _error_text())


# ---- the rules ----------------------------------------------------------------------
@dataclass(frozen=True)
class VerdictRule:
    """``undecided``: what the text rule of the same key found leaves it open (None: there
    is no such rule, all code needs an answer); ``read``: answer to row."""

    domain: str
    rule_key: str
    label: str
    undecided: Callable[[dict[str, Column]], Column] | None
    prompt: str
    read: Callable[[], Column]


VERDICT_RULES = [
    VerdictRule(fixed.CODE_QUALITY, "notebook_idempotency", fixed.LABEL_IDEMPOTENCY, None,
                fixed.PROMPT_RESTARTABLE, verdict_contains_true),
    VerdictRule(fixed.PERFORMANCE, "partitioning_and_clustering", fixed.LABEL_PARTITIONING,
                lambda m: ~m["found"], fixed.PROMPT_PARTITIONING,
                lambda: verdict_pattern(fixed.PARTITIONING_BAD, fixed.PARTITIONING_BAD)),
    VerdictRule(fixed.PERFORMANCE, "efficient_joins", fixed.LABEL_JOINS, None,
                fixed.PROMPT_JOINS, verdict_contains_true),
    VerdictRule(fixed.PERFORMANCE, "cache_usage", fixed.LABEL_CACHE,
                lambda m: ~m["found"], fixed.PROMPT_CACHE,
                lambda: verdict_pattern(fixed.CACHE_BAD, fixed.CACHE_BAD)),
    VerdictRule(fixed.SECURITY, "no_hard_coded_secrets", fixed.LABEL_SECRETS,
                lambda m: F.size(m["secrets"]) == 0, fixed.PROMPT_SECRETS,
                lambda: verdict_pattern(fixed.SECRET_UNCLEAR, fixed.SECRET_ERROR)),
    VerdictRule(fixed.SECURITY, "sql_injection_risks", fixed.LABEL_INJECTION, None,
                fixed.PROMPT_INJECTION, verdict_injection),
]
# A prompt in the catalog replaces the stock one for these.
PROMPT_FROM_CATALOG = {"partitioning_and_clustering", "cache_usage", "no_hard_coded_secrets"}
TITLES_KEY = "descriptive_cell_titles"


def _settings(catalog: Iterable[Setting]) -> dict[str, Setting]:
    return {row.rule_key: row for row in catalog if row.enabled}


def _prompt(rule: VerdictRule, setting: Setting) -> str:
    if rule.rule_key in PROMPT_FROM_CATALOG:
        return setting.parameters.get("llm_prompt", rule.prompt)
    return rule.prompt


def request_id(system: Column, user_hash: Column) -> Column:
    """Hash of the question.  The text goes in as its hash, taken once per notebook."""
    return F.sha2(F.concat(system, F.lit("\n"), user_hash), 256)


def _asking(catalog: Sequence[Setting]) -> list[tuple[VerdictRule, Setting]]:
    """Switched-on rules that a model decides."""
    listed = _settings(catalog)
    return [(rule, listed[rule.rule_key]) for rule in VERDICT_RULES if rule.rule_key in listed]


def code_questions(catalog: Sequence[Setting]) -> list[Question]:
    """One slot per rule: at most one question, about the notebook's code."""
    active = {a.rule.rule_key: a for a in active_rules(catalog)}

    def slot(rule: VerdictRule, setting: Setting) -> Question:
        def rows(found: dict[str, Column]) -> Column:
            question = request_id(F.lit(_prompt(rule, setting)), F.col("code_hash"))
            asked = F.array(_asked(question))
            return asked if rule.undecided is None else F.when(rule.undecided(found), asked)

        label = (rule.domain, rule.rule_key, rule.label, setting.severity, QUESTION)
        return Question(rule.domain, label, rows, active[rule.rule_key] if rule.undecided else None)

    return [slot(rule, setting) for rule, setting in _asking(catalog)]


def title_questions(catalog: Sequence[Setting]) -> list[Question]:
    """One slot: a question per batch of titles."""
    setting = _settings(catalog).get(TITLES_KEY)
    if setting is None:
        return []

    def rows(found: dict[str, Column]) -> Column:
        return F.transform(
            found["batches"],
            lambda b: _asked(request_id(title_prompt(b["titles"]), F.sha2(F.lit(""), 256)), b["batch"], b["titles"]),
        )

    label = (fixed.CODE_QUALITY, TITLES_KEY, fixed.LABEL_TITLE_VERDICT, setting.severity, TITLES_ASKED)
    return [Question(fixed.CODE_QUALITY, label, rows, from_cells={"batches": title_batches(F.col("cells"))})]


def _asked(question: Column, batch: Column | None = None, titles: Column | None = None) -> Column:
    nothing = F.lit(None)
    return F.struct(
        nothing.cast("string").alias("status"),
        nothing.cast("string").alias("details"),
        question.alias("request_id"),
        (nothing if batch is None else batch).cast("int").alias("batch"),
        (nothing if titles is None else titles).cast("array<string>").alias("titles"),
    )


# ---- one pass: findings, questions and title batches ----------------------------------
def tagged(
    notebooks: DataFrame,
    catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG),
    *,
    extra: Sequence[Rule] = (),
    text_rules: bool = True,
    titles: bool = True,
    code: bool = True,
) -> tuple[DataFrame, list[tuple]]:
    """``(notebook_path, slot, seq, status, details, request_id, batch, titles, tag)`` and the slots.

    One parse and one search of every notebook give findings (``tag`` finding), questions
    about its code (question) and about its titles (titles).  Rows are narrow: no text.
    """
    questions = (code_questions(catalog) if code else []) + (title_questions(catalog) if titles else [])
    rows, slots = evaluated(notebooks, catalog, extra, text_rules=text_rules, questions=questions)
    if not questions:
        nothing = {"request_id": "string", "batch": "int", "titles": "array<string>"}
        flat = rows.select("*", "row.status", "row.details", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    else:
        flat = rows.select("*", "row.*")
    tags = F.array(*[F.lit(slot[4] if len(slot) > 4 else FINDING) for slot in slots])
    return flat.drop("row").withColumn("tag", F.get(tags, F.col("slot"))), slots


def question_links(rows: DataFrame, slots: Sequence[tuple]) -> DataFrame:
    """``(path, rule_key, request_id)`` of tagged rows."""
    keys = F.array(*[F.lit(slot[1]) for slot in slots])
    asked = rows.filter(F.col("tag") == QUESTION)
    return asked.select(F.col("notebook_path").alias("path"), *copies_of(rows), F.get(keys, F.col("slot")).alias("rule_key"), "request_id")


def batch_links(rows: DataFrame) -> DataFrame:
    """``(path, batch, titles, system, request_id)`` of tagged rows."""
    asked = rows.filter(F.col("tag") == TITLES_ASKED)
    return asked.select(
        F.col("notebook_path").alias("path"), *copies_of(rows), "batch", "titles", title_prompt(F.col("titles")).alias("system"), "request_id"
    )


# ---- MDL1 ---------------------------------------------------------------------------
def request_links(notebooks: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG)) -> DataFrame:
    """``(path, rule_key, request_id)`` for every answer a notebook's code needs."""
    return question_links(*tagged(notebooks, catalog, text_rules=False, titles=False))


def distinct_questions(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(request_id, path, rule_key, rows)``: every distinct question once, with the
    first notebook that asks it and how many rows of the corpus have that path.

    Ids and paths only; what ``known`` (``request_id``) holds is left out.
    """
    asked = links.select("request_id", "path", "rule_key")
    if known is not None:
        asked = asked.join(known.select("request_id"), "request_id", "left_anti")
    by_path = asked.groupBy("request_id", "path", "rule_key").agg(F.count(F.lit(1)).alias("rows"))
    first = by_path.groupBy("request_id").agg(F.min(F.struct("path", "rule_key", "rows")).alias("first"))
    return first.select("request_id", "first.*")


def with_texts(asked: DataFrame, notebooks: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG)) -> DataFrame:
    """``(request_id, system, user)`` of distinct questions: their notebooks are looked up.

    Only those notebooks are unpacked.  A short list is broadcast and no text moves; a
    long one is the side that a hash join builds, so texts are never sorted.
    """
    asked = shared.stored(asked, "asked")
    wanted = asked.groupBy("path").agg(F.collect_set(F.struct("request_id", "rule_key", "rows")).alias("wanted"))
    chosen = notebooks.drop("copies").join(wanted.hint("shuffle_hash"), "path")
    coded = prepared(chosen).withColumn("code_hash", F.sha2("code", 256))
    prompts = F.create_map(*[F.lit(x) for rule, setting in _asking(catalog) for x in (rule.rule_key, _prompt(rule, setting))])
    each = coded.select("code", "code_hash", F.explode("wanted").alias("w")).withColumn("system", F.element_at(prompts, F.col("w.rule_key")))
    # a path may stand for other code as well, where the corpus holds it more than once
    asks = request_id(F.col("system"), F.col("code_hash")) == F.col("w.request_id")
    found = kept(each, asks, F.col("w.request_id").alias("request_id"), F.col("system"), F.col("code").alias("user"), F.col("w.rows").alias("rows"))
    if asked.filter(F.col("rows") > 1).isEmpty():
        return found.drop("rows")
    once = found.filter(F.col("rows") == 1).drop("rows")
    return once.unionByName(found.filter(F.col("rows") > 1).drop("rows").distinct())


def build_requests(
    notebooks: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), known: DataFrame | None = None
) -> DataFrame:
    """Every distinct question once: ``(request_id, system, user)``.

    Questions are told apart by their ids first, in narrow rows; ``known``: answers that
    there are already.  Then the text of one notebook per question is fetched.
    """
    if not _asking(catalog):
        return notebooks.sparkSession.createDataFrame([], REQUEST_SCHEMA)
    return with_texts(distinct_questions(request_links(notebooks, catalog), known), notebooks, catalog)


# ---- MDL2 ---------------------------------------------------------------------------
def title_batches(cells: Column, size: int = fixed.TITLE_BATCH) -> Column:
    """Titles of code cells in groups of ``size``, in cell order."""
    titles = F.filter(F.transform(code_cells(cells), title_of), lambda title: title != "")

    def groups(found: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int"))
        cut = F.transform(starts, lambda b: F.struct(b.alias("batch"), F.slice(found, b * size + 1, size).alias("titles")))
        return F.when(F.size(found) > 0, cut).otherwise(F.array().cast("array<struct<batch:int,titles:array<string>>>"))

    # One-element array: binds the titles so they are gathered once.
    return F.transform(F.array(titles), groups)[0]


def title_prompt(titles: Column) -> Column:
    lines = F.transform(titles, lambda title, i: F.concat((i + 1).cast("string"), F.lit(". "), title, F.lit("\n")))
    return F.concat(F.lit(fixed.PROMPT_TITLES), F.array_join(lines, ""))


def title_links(notebooks: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG)) -> DataFrame:
    """``(path, batch, titles, system, request_id)``; no shuffle."""
    return batch_links(tagged(notebooks, catalog, text_rules=False, code=False)[0])


def title_requests(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The distinct title questions, as requests with an empty user text."""
    asked = links.select("request_id", "titles")
    if known is not None:
        asked = asked.join(known.select("request_id"), "request_id", "left_anti")
    return asked.distinct().select("request_id", title_prompt(F.col("titles")).alias("system"), F.lit("").alias("user"))


def batch_title_prompts(notebooks: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG)) -> DataFrame:
    return title_requests(title_links(notebooks, catalog))


# ---- MDL3 ---------------------------------------------------------------------------
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def parse_title_verdicts(content: Column) -> Column:
    """Answer lines to ``array<struct<descriptive, explanation>>``; blank lines do not count."""

    def verdict(line: Column) -> Column:
        parts = F.split(line, " ", 3)
        readable = F.size(parts) >= 2
        word, rest = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
        return F.struct(
            (readable & F.contains(F.lower(F.coalesce(word, F.lit(""))), F.lit("true"))).alias("descriptive"),
            F.when(readable, F.coalesce(rest, F.lit(""))).otherwise(F.lit(fixed.VERDICT_PARSE_ERROR)).alias("explanation"),
        )

    lines = F.transform(F.split(content, LINE_ENDS), text.strip)
    return F.transform(F.filter(lines, lambda line: line != ""), verdict)


def title_verdicts(links: DataFrame, responses: DataFrame) -> DataFrame:
    """Per title its verdict, ``(path, seq, title, status, details)``.

    Answer lines are matched to titles by position over the whole notebook:
    lines beyond the last title are dropped, titles without a line get no row.
    A batch in error fails each of its titles, an unanswered one leaves them
    pending.  A group is the batches of one notebook, which came out of one row.
    """
    joined = links.join(responses, "request_id", "left")
    lines = F.transform(
        parse_title_verdicts(F.col("content")),
        lambda v: F.struct(F.when(v["descriptive"], fixed.PASSED).otherwise(fixed.FAILED).alias("status"), v["explanation"].alias("explanation")),
    )

    def for_all(status: str, explanation: Column) -> Column:
        return F.transform("titles", lambda _t: F.struct(F.lit(status).alias("status"), explanation.alias("explanation")))

    verdicts = (
        F.when(F.col("error").isNotNull(), for_all(fixed.FAILED, _error_text()))
        .when(F.col("content").isNull(), for_all(fixed.PENDING, F.lit(fixed.UNANSWERED)))
        .otherwise(lines)
    )
    copies = copies_of(joined)
    batches = joined.select("path", *copies, F.struct("batch", "titles", verdicts.alias("verdicts")).alias("b"))
    whole = batches.groupBy("path", *copies).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    flat = whole.select("path", *copies, F.flatten("bs.titles").alias("titles"), F.flatten("bs.verdicts").alias("verdicts"))
    kept = F.slice("verdicts", 1, F.size("titles"))
    rows = flat.select("path", *copies, "titles", F.posexplode(kept).alias("seq", "v"))
    titled = rows.withColumn("title", F.get("titles", F.col("seq")))
    details = F.concat(F.lit(fixed.TITLE_VERDICT[0]), F.col("title"), F.lit(fixed.TITLE_VERDICT[1]), F.col("v.explanation"))
    return titled.select("path", *copies, "seq", "title", F.col("v.status").alias("status"), details.alias("details"))


# ---- MDL7 ---------------------------------------------------------------------------
def score_requests(
    requests: DataFrame, answer: Callable[[str, str], str], parallelism: int, store: ResponseStore | None = None
) -> DataFrame:
    """Apply ``answer(system, user)`` to every request, ``parallelism`` at a time.

    An exception becomes the row's ``error``.  With a ``store``, only questions that it
    can't answer are asked, and all its answers are returned.  Without one, answers are
    written once to the shared folder, so reading them again never asks again; questions
    are asked in as many rounds as keep a task's texts near ``responses.TASK_BYTES``.
    """
    if store is not None:
        return store.score(requests, answer, parallelism)
    asked = shared.stored(requests.select("request_id", "system", "user"), "asked")
    size = asked.agg(F.sum(F.coalesce(F.octet_length("system"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("user"), F.lit(0)))).first()[0]
    rounds = 1 + (size or 0) // (parallelism * scoring.TASK_BYTES)
    location = shared.new_location(asked.sparkSession, "responses")
    for part in scoring.dealt(asked, rounds):
        # Spread by the question's hash: repeatable, and even whatever the texts are.
        spread = part.repartition(parallelism, "request_id")
        spread.mapInPandas(answered_by(answer), RESPONSE_SCHEMA).write.mode("append").parquet(location)
    return asked.sparkSession.read.schema(RESPONSE_SCHEMA).parquet(location)


# ---- MDL8 ---------------------------------------------------------------------------
def join_verdicts(links: DataFrame, responses: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), run_id: str = "") -> DataFrame:
    """Findings for the rules a model decides.  Unanswered questions are pending.

    Both sides are narrow.  If copies make one question very frequent, it is the
    left side that is skewed, which adaptive execution splits.
    """
    rules = _asking(catalog)
    joined = links.join(responses, "request_id", "left")

    def pick(value: Callable[[VerdictRule, Setting], Column]) -> Column:
        chosen = F.lit(None)
        for rule, setting in rules:
            chosen = F.when(F.col("rule_key") == rule.rule_key, value(rule, setting)).otherwise(chosen)
        return chosen

    rows = joined.select(
        F.col("path").alias("notebook_path"),
        *copies_of(links),
        "rule_key",
        pick(lambda rule, _: F.lit(rule.domain)).alias("domain"),
        pick(lambda rule, _: F.lit(rule.label)).alias("rule"),
        pick(lambda _, setting: F.lit(setting.severity)).alias("severity"),
        F.lit(0).alias("seq"),
        pick(lambda rule, _: rule.read()).cast(ROW).alias("row"),
    )
    return identified(rows.select("*", "row.status", "row.details").drop("row"), run_id)


def title_findings(links: DataFrame, responses: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), run_id: str = "") -> DataFrame:
    setting = _settings(catalog).get(TITLES_KEY)
    verdicts = title_verdicts(links, responses)
    rows = verdicts.select(
        F.col("path").alias("notebook_path"),
        *copies_of(links),
        F.lit(fixed.CODE_QUALITY).alias("domain"),
        F.lit(TITLES_KEY).alias("rule_key"),
        F.lit(fixed.LABEL_TITLE_VERDICT).alias("rule"),
        F.lit(setting.severity if setting else None).cast("string").alias("severity"),
        "seq",
        "status",
        "details",
    )
    return identified(rows, run_id)


def answered_findings(
    rows: DataFrame, slots: Sequence[tuple], responses: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), run_id: str = ""
) -> DataFrame:
    """Findings of the questions among tagged rows, given the responses."""
    by_code = join_verdicts(question_links(rows, slots), responses, catalog, run_id)
    return by_code.unionByName(title_findings(batch_links(rows), responses, catalog, run_id))


def verdict_findings(
    notebooks: DataFrame, responses: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), run_id: str = ""
) -> DataFrame:
    """All findings of rules a model decides, given the stored responses.

    Notebooks are unpacked once; questions are stored and read by their kind.
    """
    rows, slots = tagged(notebooks, catalog, text_rules=False)
    return answered_findings(shared.stored(rows, "questions", by="tag"), slots, responses, catalog, run_id)


def all_requests(
    notebooks: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), known: DataFrame | None = None
) -> DataFrame:
    """Every distinct question about code and titles, but for those ``known``."""
    rows, slots = tagged(notebooks, catalog, text_rules=False)
    return requests_of(shared.stored(rows, "questions", by="tag"), slots, notebooks, catalog, known)


def requests_of(
    rows: DataFrame, slots: Sequence[tuple], notebooks: DataFrame, catalog: Sequence[Setting], known: DataFrame | None = None
) -> DataFrame:
    """The distinct questions among tagged rows with their texts, but for those ``known``."""
    by_title = title_requests(batch_links(rows), known)
    if not _asking(catalog):
        return by_title
    return with_texts(distinct_questions(question_links(rows, slots), known), notebooks, catalog).unionByName(by_title)


# ---- MDL9, MDL10 ----------------------------------------------------------------------
def single_requests(texts: DataFrame, system: str, user: str) -> DataFrame:
    """One question per row of ``texts``: its columns plus request id, system, user."""
    return texts.withColumns({"system": F.lit(system), "user": F.col(user)}).withColumn(
        "request_id", request_id(F.col("system"), F.sha2("user", 256))
    )


def name_descriptive(names: DataFrame, responses: DataFrame, column: str = "name") -> DataFrame:
    """``(name, descriptive, explanation)``; null where unanswered."""
    links = single_requests(names.select(column).distinct(), fixed.PROMPT_NAME, column).select(column, "request_id")
    answered = links.join(responses, "request_id", "left")
    descriptive = F.when(F.col("error").isNotNull(), F.lit(False)).otherwise(contains_true(F.col("content")))
    explanation = F.when(F.col("error").isNotNull(), F.lit(fixed.NAME_ERROR)).otherwise(F.col("content"))
    return answered.select(column, descriptive.alias("descriptive"), explanation.alias("explanation"))


def blank_space(notebooks: DataFrame, responses: DataFrame) -> DataFrame:
    """``(path, unnecessary, explanation)`` on unnecessary whitespace; null where unanswered."""
    coded = kept(prepared(notebooks), F.col("readable"), "path", "code")
    links = single_requests(coded, fixed.PROMPT_BLANK_SPACE, "code").select("path", "request_id")
    answered = links.join(responses, "request_id", "left")
    unnecessary = F.when(F.col("error").isNotNull(), F.lit(False)).otherwise(contains_true(F.col("content")))
    explanation = F.when(F.col("error").isNotNull(), _error_text()).otherwise(F.col("content"))
    return answered.select("path", unnecessary.alias("unnecessary"), explanation.alias("explanation"))
