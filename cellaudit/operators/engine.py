"""Evaluating rules on notebooks: one row per finding.

The whole evaluation is narrow.  Code text is put together once per notebook and
each search runs once over it.  Every rule fills one slot of an array with its
rows; slots and rows are then exploded, and a slot's number says which rule it
is.  There is no shuffle, and no Python unless a Python rule is given.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, shared, text
from ..functions.rows import repeated
from ..sources import notebooks as source
from ..sources.findings import redact_secrets
from . import summary
from .catalog import DEFAULT_CATALOG, Setting
from .cells import cell_text, first_n_cells, with_code
from .rules import BUILT_IN, Rule, custom
from .rules.base import CODE, HEAD, LANGUAGE, TITLES, failed

FINDING_COLUMNS = [
    "rule", "status", "details", "notebook_path", "audit_time", "audit_id", "domain", "rule_key", "severity", "seq",
]
DOMAIN_ORDER = [fixed.CODE_QUALITY, fixed.PERFORMANCE, fixed.SECURITY, fixed.GOVERNANCE, fixed.CUSTOM]


@dataclass(frozen=True)
class Active:
    """A rule that is switched on, with its setting."""

    rule: Rule
    severity: str
    parameters: dict


def active_rules(catalog: Iterable[Setting], extra: Sequence[Rule] = ()) -> list[Active]:
    """Enabled rules in evaluation order.  A built-in rule not listed in the catalog is off.

    A rule of one's own (``extra``) is on with severity "warning" unless the catalog lists
    its key: then the catalog says whether it is on, how severe it is and its parameters.
    """
    every = {row.rule_key: row for row in catalog}
    own = {rule.rule_key for rule in extra}
    listed = {key: row for key, row in every.items() if row.enabled and key not in own}
    active = [
        Active(rule, listed[rule.rule_key].severity, listed[rule.rule_key].parameters)
        for rule in BUILT_IN
        if rule.rule_key in listed
    ]
    for row in listed.values():
        if row.domain == fixed.CUSTOM:
            active.append(Active(custom.rule_from_setting(row.domain, row.rule_key, row.label), row.severity, row.parameters))
    for rule in extra:
        row = every.get(rule.rule_key)
        if row is None:
            active.append(Active(rule, "warning", {}))
        elif row.enabled:
            active.append(Active(rule, row.severity, row.parameters))
    return sorted(active, key=lambda a: DOMAIN_ORDER.index(a.rule.domain))


# ---- FND1 ------------------------------------------------------------------------
LABEL = "struct<domain:string,rule_key:string,rule:string,severity:string>"


def labels(rows: Sequence[tuple[str | None, str, str, str]]) -> Column:
    """What the slots of an audit stand for, as one constant array."""
    names = ["domain", "rule_key", "rule", "severity"]
    return F.from_json(F.lit(json.dumps([dict(zip(names, row)) for row in rows])), f"array<{LABEL}>")


def identified(rows: DataFrame, run_id: str = "") -> DataFrame:
    """Adds time and id.  The id is a hash of what the finding is about, so a
    retried task writes the same id again, and so does a run repeated under its ``run_id``.
    Texts come with their lengths, so that no two findings spell the same.

    Findings of a notebook that was requested n times come n times.
    """
    keys = ["notebook_path", "rule", "seq"]
    rows = repeated(rows, keys) if "copies" in rows.columns else rows.withColumn("copy", F.lit(1))
    texts = [F.lit(run_id), *[F.coalesce(name, F.lit("")) for name in ("notebook_path", "domain", "rule_key", "rule")]]
    parts = [part for text in texts for part in (F.length(text).cast("string"), text)]
    numbers = [F.col(name).cast("string") for name in ("copy", "seq")]
    with_id = rows.withColumn("audit_id", F.sha2(F.concat_ws("|", *parts, *numbers), 256))
    return with_id.withColumn("audit_time", F.current_timestamp()).select(*FINDING_COLUMNS)


# ---- FND4 ------------------------------------------------------------------------
def _first(problems: Column, name: str) -> Column:
    return F.get(problems, F.lit(0))[name]


def _not_a_cell(cell: Column) -> Column:
    return F.coalesce(cell["source_problem"] == source.BAD_CELLS, F.lit(False))


def code_problem() -> Column:
    """Why the code text cannot be put together, or null."""
    bad = F.filter(
        "cells", lambda cell: cell["source_problem"].isNotNull() & ((cell["cell_type"] == "code") | _not_a_cell(cell))
    )
    return F.coalesce(F.col("cells_problem"), _first(bad, "source_problem"))


def title_problem() -> Column:
    bad = F.filter("cells", lambda cell: _not_a_cell(cell) | ((cell["cell_type"] == "code") & cell["title_problem"].isNotNull()))
    reason = F.coalesce(F.when(_first(bad, "source_problem") == source.BAD_CELLS, F.lit(source.BAD_CELLS)), _first(bad, "title_problem"))
    return F.coalesce(F.col("cells_problem"), reason)


def head_problem(p: dict) -> Column:
    """Cells before the first header are read, later ones are not."""
    head = first_n_cells(F.col("cells"), p.get("header_cells", 2))
    words = p.get("header_keywords", ["header"])
    bad = F.filter(head, lambda cell: cell["source_problem"].isNotNull())
    titled = F.filter(head, lambda cell: text.contains_any(F.lower(cell_text(cell)), words))
    header_at = F.coalesce(_first(titled, "pos"), F.lit(2**31 - 1))
    reason = F.when(_first(bad, "pos") < header_at, _first(bad, "source_problem"))
    return F.coalesce(F.col("cells_problem"), reason)


def with_problems(notebooks: DataFrame, reads: dict[str, dict[str, dict]]) -> DataFrame:
    """One column per kind of reading, with what goes wrong in it."""
    reasons = {CODE: lambda p: code_problem(), TITLES: lambda p: title_problem(), HEAD: head_problem}
    needed = {what: p for domain in reads.values() for what, p in domain.items() if what in reasons}
    return notebooks.withColumns({f"problem_{what}": reasons[what](p) for what, p in needed.items()})


def domain_problem(reads: dict[str, dict]) -> Column:
    """The first problem the rules of a domain meet, in order; null if none."""
    found = [F.col(f"problem_{what}") for what in reads if what != LANGUAGE]
    return F.coalesce(*found, F.lit(None).cast("string"))


# ---- FND2, FND3 --------------------------------------------------------------------
def copies_of(notebooks: DataFrame) -> list[str]:
    """The column that says how often a notebook was requested, if there is one."""
    return ["copies"] if "copies" in notebooks.columns else []


def parsed(notebooks: DataFrame) -> DataFrame:
    """Parsed notebooks; a raw corpus is parsed first."""
    return source.parse_notebooks(notebooks) if "content" in notebooks.columns else notebooks


def prepared(notebooks: DataFrame) -> DataFrame:
    """Parsed notebooks with their code."""
    books = parsed(notebooks)
    return books if "folded" in books.columns else with_code(books)


def domain_reads(catalog: Iterable[Setting], active: Sequence[Active]) -> dict[str, dict[str, dict]]:
    """Per domain what its switched-on rules read, rules that ask a model included."""
    reads: dict[str, dict[str, dict]] = {}
    for a in active:
        reads.setdefault(a.rule.domain, {}).setdefault(a.rule.reads, a.parameters)
    known = {rule.rule_key for rule in BUILT_IN} | {a.rule.rule_key for a in active}
    for row in catalog:
        if row.enabled and row.rule_key not in known and row.domain != fixed.CUSTOM:
            reads.setdefault(row.domain, {}).setdefault(CODE, {})
    return reads


@dataclass(frozen=True)
class Question:
    """A slot for what a model has to decide: ``rows`` makes questions of a rule's scan
    columns; ``of`` is the text rule that leaves some notebooks undecided."""

    domain: str
    label: tuple
    rows: Callable[[dict[str, Column]], Column]
    of: Active | None = None
    from_cells: dict[str, Column] = field(default_factory=dict)


#: What a row of an audit holds if questions are part of it.
TAGGED = "struct<status:string,details:string,request_id:string,batch:int,titles:array<string>>"
FINDING, QUESTION, TITLES_ASKED = "finding", "question", "titles"


def slotted(
    notebooks: DataFrame,
    catalog: Sequence[Setting],
    extra: Sequence[Rule] = (),
    *,
    text_rules: bool = True,
    questions: Sequence[Question] = (),
) -> tuple[DataFrame, list[tuple[tuple, Column]]]:
    """Notebooks with what was found in them, and the slots: labels and rows made of it.

    Order of slots is domain, rule.
    """
    active = active_rules(catalog, extra)
    reads = domain_reads(catalog, active)
    base = with_problems(parsed(notebooks), reads)

    # Slots: what can go wrong first, then the rules; their order is the findings' order.
    scans: dict[str, Column] = {}
    cell_scans: dict[str, Column] = {}
    slots: list[tuple[tuple, Column]] = []

    def scanned(rule_key: str, scan: dict[str, Column], from_cells: dict[str, Column]) -> dict[str, Column]:
        names = {part: f"{rule_key}__{part}" for part in [*scan, *from_cells]}
        scans.update({names[part]: column for part, column in scan.items()})
        cell_scans.update({names[part]: column for part, column in from_cells.items()})
        return {part: F.col(full) for part, full in names.items()}

    def tagged(rows: Column) -> Column:
        if not questions:
            return rows
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("request_id", "string"), ("batch", "int"), ("titles", "array<string>"))]
        return F.transform(rows, lambda row: F.struct(row["status"].alias("status"), row["details"].alias("details"), *nothing))

    if text_rules:
        slots.append((ACCESS, tagged(F.when(~F.col("readable"), _unreadable()))))
    for domain in DOMAIN_ORDER:
        if domain not in reads:
            continue
        problem = domain_problem(reads[domain])
        stopped = F.col("readable") & problem.isNotNull()
        going = F.col("readable") & problem.isNull()
        if text_rules:
            name = f"{fixed.DOMAIN_NAMES[domain]} Error"
            error = F.array(failed(F.concat(F.lit(fixed.DOMAIN_ERROR_PREFIX), problem)))
            slots.append(((domain, "domain_error", name, "error"), tagged(F.when(stopped, error))))
            for a in active:
                if a.rule.domain == domain:
                    check = a.rule.check(a.parameters)
                    rows = check.rows(scanned(a.rule.rule_key, check.scan, check.from_cells))
                    slots.append(((domain, a.rule.rule_key, a.rule.label, a.severity), tagged(F.when(going, rows))))
        for q in questions:
            if q.domain == domain:
                check = q.of.rule.check(q.of.parameters) if q.of else None
                found = scanned(q.label[1], check.scan if check else {}, {**(check.from_cells if check else {}), **q.from_cells})
                slots.append((q.label, F.when(going, q.rows(found))))

    # What looks at cells is taken together with the code, so that cells, texts of
    # the same size as the code, go no further.
    coded = prepared(base.withColumns(cell_scans) if cell_scans else base)
    if questions:
        scans["code_hash"] = F.sha2("code", 256)
    if not slots:
        slots.append((ACCESS, F.array().cast(f"array<{TAGGED}>")))
    return (coded.withColumns(scans) if scans else coded), slots


def evaluated(
    notebooks: DataFrame,
    catalog: Sequence[Setting],
    extra: Sequence[Rule] = (),
    *,
    text_rules: bool = True,
    questions: Sequence[Question] = (),
) -> tuple[DataFrame, list[tuple]]:
    """``(notebook_path, slot, seq, row)`` of one narrow pass, and what the slots stand for.

    ``seq`` counts the rows of one slot.
    """
    searched, slots = slotted(notebooks, catalog, extra, text_rules=text_rules, questions=questions)
    copies = copies_of(searched)
    by_slot = searched.select(
        F.col("path").alias("notebook_path"), *copies, F.posexplode(F.array(*[rows for _, rows in slots])).alias("slot", "rows")
    )
    by_row = by_slot.select("notebook_path", *copies, "slot", F.posexplode("rows").alias("seq", "row"))
    return by_row, [label for label, _ in slots]


def labelled(rows: DataFrame, slots: Sequence[tuple], run_id: str = "") -> DataFrame:
    """Findings of rows ``(notebook_path, slot, seq, status, details)``."""
    label = F.get(labels([slot[:4] for slot in slots]), F.col("slot"))
    named = rows.select("notebook_path", *copies_of(rows), label.alias("label"), "status", "details", "seq")
    return identified(named.select("*", "label.*"), run_id)


def validate(
    notebooks: DataFrame,
    catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG),
    *,
    extra: Sequence[Rule] = (),
    run_id: str = "",
) -> DataFrame:
    """All findings the text of the notebooks decides.

    Rules that need a model's answer are in ``verdicts``, both kinds together in
    ``audit``.  Order within a notebook is domain, rule, match; ``seq`` counts the
    rows of one rule.
    """
    rows, slots = evaluated(notebooks, catalog, extra)
    return labelled(rows.select("*", "row.status", "row.details"), slots, run_id)


ACCESS = (None, "notebook_access", fixed.ACCESS_LABEL, "error")


def _unreadable() -> Column:
    return F.array(failed(_access_details(F.concat(F.lit(fixed.ACCESS_UNREADABLE), F.col("path")))))


def _access_details(reason: Column) -> Column:
    return F.concat(F.lit(fixed.ACCESS_PREFIX), F.col("path"), F.lit(": "), reason)


# ---- SRC6 ------------------------------------------------------------------------
def missing_findings(corpus: DataFrame, requested: DataFrame, run_id: str = "") -> DataFrame:
    """One access finding for every request of a notebook the corpus lacks."""
    missing = source.missing_notebooks(corpus, requested)
    named = zip(["domain", "rule_key", "rule", "severity"], ACCESS)
    rows = missing.select(
        F.col("path").alias("notebook_path"),
        "copies",
        *[F.lit(value).cast("string").alias(name) for name, value in named],
        F.lit(fixed.FAILED).alias("status"),
        _access_details(F.concat(F.lit(fixed.ACCESS_MISSING), F.col("path"))).alias("details"),
        F.lit(0).alias("seq"),
    )
    return identified(rows, run_id)


def validate_requested(
    corpus: DataFrame,
    requested: DataFrame,
    catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG),
    *,
    extra: Sequence[Rule] = (),
    run_id: str = "",
) -> DataFrame:
    """Findings for a list of requested paths, missing ones included."""
    found = validate(source.load_requested(corpus, requested), catalog, extra=extra, run_id=run_id)
    return found.unionByName(missing_findings(corpus, requested, run_id))


def in_order(findings: DataFrame) -> DataFrame:
    """Findings sorted for reading: by notebook, then as its rules were evaluated.

    Sorting by more than the path splits a notebook with very many findings.
    """
    known = F.array_position(F.lit(fixed.LABEL_ORDER), F.col("rule"))
    last = F.when(known > 0, known).otherwise(len(fixed.LABEL_ORDER) + 1)
    return findings.orderBy("notebook_path", last, "rule", "seq", "audit_id")


# ---- FND9 ------------------------------------------------------------------------
def run_validation(
    corpus: DataFrame,
    paths: list[str] | None = None,
    catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG),
    *,
    extra: Sequence[Rule] = (),
    run_id: str = "",
    redact: bool = True,
) -> dict[str, DataFrame]:
    """Findings and their summaries; findings are computed and stored once.

    As in every stored form, found secrets are masked unless told otherwise.
    """
    chosen = corpus if paths is None else source.select_paths(corpus, paths)
    found = validate(chosen, catalog, extra=extra, run_id=run_id)
    findings = shared.stored(redact_secrets(found) if redact else found, "findings")
    return {
        "findings": findings,
        "total": summary.summary_total(findings),
        "by_rule": summary.summary_by_rule(findings),
        "by_notebook": summary.summary_by_notebook(findings),
    }
