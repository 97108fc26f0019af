"""What a rule is, and the few ways rules build their finding rows.

A rule contributes two things to the audit's projections: ``scan`` columns, what
it finds in a notebook (each search is written and run once), and ``rows``, an
``array<struct<status,details>>`` built from the scan columns only, so that texts
are left behind before findings are put together.  How many rows a notebook gets
is part of a rule's meaning: none, one, or one per match.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed, text

ROW = "struct<status:string,details:string>"
ROWS = f"array<{ROW}>"

# What a rule reads of a notebook; decides which malformed cells stop its domain.
LANGUAGE, HEAD, TITLES, CODE = "language", "head", "titles", "code"


@dataclass(frozen=True)
class Check:
    """``from_cells`` holds the scan columns that look at cells instead of code."""

    rows: Callable[[dict[str, Column]], Column]
    scan: dict[str, Column] = field(default_factory=dict)
    from_cells: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    domain: str
    rule_key: str
    label: str
    reads: str
    check: Callable[[dict], Check]


def passed(details: Column | str) -> Column:
    return _row(fixed.PASSED, details)


def failed(details: Column | str) -> Column:
    return _row(fixed.FAILED, details)


def _row(status: str, details: Column | str) -> Column:
    details = F.lit(details) if isinstance(details, str) else details
    return F.struct(F.lit(status).alias("status"), details.alias("details"))


def no_rows() -> Column:
    return F.array().cast(ROWS)


def quoted(around: tuple[str, str], value: Column) -> Column:
    return F.concat(F.lit(around[0]), value, F.lit(around[1]))


def one(condition: Column, then: Column, otherwise: Column) -> Column:
    """Exactly one row: which one depends on ``condition``."""
    return F.array(F.when(condition, then).otherwise(otherwise))


def each(matches: Column, to_row: Callable[[Column], Column]) -> Column:
    return F.transform(matches, to_row)


def repeat_or(count: Column, row: Column, none: Column) -> Column:
    """``row`` once per match, or the row ``none`` where there is no match."""
    return F.when(count > 0, F.array_repeat(row, count)).otherwise(F.array(none))


def code_matches(pattern: str, group: int = 0, *, needs: Sequence[str], dotall: bool = False) -> Column:
    """Matches of ``pattern`` in the notebook's code, as written there.

    ``needs`` are lower-case fragments one of which every match contains; code
    with none of them is not searched.  No fragments: always searched.
    """
    found = text.find_all(F.col("code"), pattern, group, dotall=dotall)
    if not needs:
        return found
    return F.when(text.contains_any(F.col("folded"), needs), found).otherwise(F.array().cast("array<string>"))


def code_count(pattern: str, *, needs: Sequence[str], dotall: bool = False) -> Column:
    """How often ``pattern`` occurs in the notebook's code."""
    count = F.regexp_count("folded", F.lit(text.folded_regex(pattern, dotall=dotall)))
    return F.when(text.contains_any(F.col("folded"), needs), count).otherwise(0)


def code_has(pattern: str, *, needs: Sequence[str]) -> Column:
    found = F.col("folded").rlike(text.folded_regex(pattern))
    return text.contains_any(F.col("folded"), needs) & found


def code_has_word(pattern: str) -> Column:
    """For patterns that are plain alternatives: no regex is needed."""
    return text.contains_any(F.col("folded"), text.literals(pattern))


def any_on_line(alternatives: Sequence[str], *, needs: Sequence[str]) -> Column:
    """One of several ``head.*tail`` patterns occurs on some line."""
    found = F.lit(False)
    for pattern in alternatives:
        found = found | F.col("folded").rlike(text.folded_regex(text.first_on_line(pattern)))
    return text.contains_any(F.col("folded"), needs) & found
