"""Rules of one's own, written as Columns or in Python."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from ..functions import fixed
from .rules import Check, Rule
from .rules.base import CODE, ROWS
from .rules.custom import register_rule

__all__ = ["python_rule", "register_rule"]


# ---- UDX2 ------------------------------------------------------------------------
def python_rule(rule_key: str, label: str, fn: Callable[..., list[tuple[str, str]]], domain: str = fixed.CUSTOM) -> Rule:
    """A rule in Python: ``fn(code)``, or ``fn(code, parameters)``, gives ``[(status, details), ...]``.

    Parameters are those that the catalog lists for ``rule_key``.  Code reaches Python in Arrow batches and only in audits that have such a
    rule; the built-in rules stay as they are.
    """

    more = len(inspect.signature(fn).parameters) > 1

    def check(parameters: dict) -> Check:
        given = (parameters,) if more else ()

        def rows(code: pd.Series) -> pd.Series:
            return pd.Series([[{"status": s, "details": d} for s, d in fn(c, *given)] for c in code])

        return Check(lambda m: m["rows"], {"rows": F.pandas_udf(rows, ROWS)(F.col("code"))})

    return Rule(domain, rule_key, label, CODE, check)
