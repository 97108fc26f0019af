"""Security rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed
from .base import CODE, Check, Rule, code_has_word, code_matches, each, failed, one, passed

# Fragments every match of a stock pattern has; other patterns are always searched.
SECRET_NEEDS = dict(zip(fixed.SECRETS, (["bearer"], ["dapi"], ["password"])))


def secret_matches(p: dict) -> Column:
    """Matched texts: patterns in the given order, matches of each in text order."""
    patterns = p.get("regex_patterns", fixed.SECRETS)
    if not patterns:
        return F.array().cast("array<string>")
    return F.concat(*[code_matches(pattern, needs=SECRET_NEEDS.get(pattern, ())) for pattern in patterns])


def secrets(p: dict) -> Check:
    return Check(
        lambda m: each(m["secrets"], lambda match: failed(F.concat(F.lit(fixed.SECRET_FOUND), match))),
        {"secrets": secret_matches(p)},
    )


def access_controls(p: dict) -> Check:
    found = code_has_word(fixed.GRANTS)
    return Check(lambda m: one(m["found"], passed(fixed.ACCESS_OK), failed(fixed.ACCESS_BAD)), {"found": found})


RULES = [
    Rule(fixed.SECURITY, "no_hard_coded_secrets", fixed.LABEL_SECRETS, CODE, secrets),
    Rule(fixed.SECURITY, "access_controls", fixed.LABEL_ACCESS_CONTROLS, CODE, access_controls),
]
