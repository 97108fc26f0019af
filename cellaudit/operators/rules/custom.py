"""User-defined rules: naming patterns and keyword lists from the catalog, or own Columns.

A catalog row of the custom domain needs no code: its parameters say what to check.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed, text
from .base import CODE, Check, Rule, code_matches, each, failed, passed
from .quality import table_bodies, table_columns


# ---- R22 ---------------------------------------------------------------------
def _names(names: Column, what: str, pattern: str) -> Column:
    def row(name: Column) -> Column:
        shown = F.concat(F.lit(f"{what} '"), name)
        return F.when(
            name.rlike(text.java_regex(pattern, ignore_case=False)), passed(F.concat(shown, F.lit("' matches the naming pattern")))
        ).otherwise(failed(F.concat(shown, F.lit(f"' does not match {pattern}"))))

    return each(names, row)


def _words(words: list[str], present: bool) -> list[Column]:
    rows = []
    for word in words:
        # Word by word, ignoring case; lower and upper folding agree on plain words.
        found = F.contains(F.col("folded"), F.lit(word.lower()))
        yes, no = (passed, failed) if present else (failed, passed)
        rows.append(F.when(found, yes(f"'{word}' found")).otherwise(no(f"'{word}' not found")))
    return rows


def custom_regex(p: dict) -> Check:
    """Rows per table name, per column name, per required and per disallowed keyword."""
    patterns = p.get("patterns", {})
    scan = {}
    if "table_names" in patterns:
        scan["tables"] = code_matches(fixed.TABLE_NAME, 1, needs=["create table"])
    if "column_names" in patterns:
        scan["bodies"] = table_bodies()

    def rows(m: dict) -> Column:
        parts = []
        if "tables" in m:
            parts.append(_names(m["tables"], "Table name", patterns["table_names"]))
        if "bodies" in m:
            names = F.transform(table_columns(m["bodies"]), lambda column: column["name"])
            parts.append(_names(names, "Column name", patterns["column_names"]))
        words = _words(p.get("require_encryption_keywords", []), True) + _words(p.get("disallowed_functions", []), False)
        if words:
            parts.append(F.array(*words))
        return F.concat(*parts) if parts else F.array()

    return Check(rows, scan)


def rule_from_setting(domain: str, rule_key: str, label: str) -> Rule:
    return Rule(domain, rule_key, label, CODE, custom_regex)


# ---- UDX1 --------------------------------------------------------------------
def register_rule(rule_key: str, label: str, rows: Callable[..., Column], domain: str = fixed.CUSTOM) -> Rule:
    """A rule of one's own from a Column ``array<struct<status,details>>``.

    ``rows`` may use the columns ``path``, ``language``, ``cells``, ``code`` and
    ``folded``; build rows with ``passed`` and ``failed``.  If it takes an argument, it
    is given the parameters that the catalog lists for ``rule_key``.
    """
    takes = len(inspect.signature(rows).parameters)
    return Rule(domain, rule_key, label, CODE, lambda p: Check(lambda m: m["rows"], {"rows": rows(p) if takes else rows()}))
