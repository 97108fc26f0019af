"""Governance rules: metastore, comments, version control, environments, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed, text
from ..cells import comment_lines, written_lines
from .base import CODE, Check, Rule, any_on_line, code_has, code_has_word, code_matches, each, failed, one, passed, quoted


def metastore(p: dict) -> Check:
    found = code_has(fixed.OLD_METASTORE, needs=["dbfs", "hive_metastore"])
    return Check(lambda m: one(m["found"], failed(fixed.CATALOG_BAD), passed(fixed.CATALOG_OK)), {"found": found})


def comments(p: dict) -> Check:
    least = p.get("min_comment_ratio", 0.1)
    starts = p.get("check_patterns", fixed.COMMENT_STARTS)
    lines = written_lines(F.col("code"))
    before, after, end = fixed.COMMENTS_BAD

    def rows(m: dict) -> Column:
        total, commented = m["counts"]["total"], m["counts"]["commented"]
        ratio = F.try_divide(commented, total)
        share = text.percent_text(ratio)
        short = F.concat(F.lit(before), share, F.lit(f"{after}{least:.1%}{end}"))
        return F.array(
            F.when(total == 0, passed(fixed.COMMENTS_NONE))
            .when(ratio >= F.lit(float(least)), passed(quoted(fixed.COMMENTS_OK, share)))
            .otherwise(failed(short))
        )

    # The lines are bound once and counted twice.
    counts = F.transform(
        F.array(lines),
        lambda ls: F.struct(F.size(ls).alias("total"), F.size(comment_lines(ls, starts)).alias("commented")),
    )
    return Check(rows, {"counts": counts[0]})


def version_control(p: dict) -> Check:
    found = any_on_line(fixed.REPO_RUN.split("|"), needs=["repos"])
    return Check(
        lambda m: one(m["found"], passed(fixed.VERSION_CONTROL_OK), failed(fixed.VERSION_CONTROL_BAD)), {"found": found}
    )


def isolation(p: dict) -> Check:
    return Check(
        lambda m: one(m["any"] & ~m["mixed"], passed(fixed.ISOLATION_OK), failed(fixed.ISOLATION_BAD)),
        {
            "any": code_has_word(fixed.ENVIRONMENT_PATH),
            "mixed": any_on_line(fixed.MIXED_ENVIRONMENTS.strip("()").split("|"), needs=["dev/", "staging/"]),
        },
    )


def tagging(p: dict) -> Check:
    """``metadata_scope``: where a table's tags are looked for.

    ``match`` (default) looks only inside the matched ``CREATE TABLE name`` text,
    which cannot hold properties, so every required tag is missing; ``statement``
    looks from there to the next semicolon or the next ``CREATE TABLE``.
    """
    tags = list(p.get("required_tags", ["OWNER", "CLASSIFICATION", "PURPOSE"]))
    statement = p.get("metadata_scope", "match") == "statement"

    def row(name: Column, missing: Column) -> Column:
        bad = F.concat(quoted(fixed.TAGS_BAD, name), F.array_join(missing, ", "))
        return F.when(F.size(missing) > 0, failed(bad)).otherwise(passed(quoted(fixed.TAGS_OK, name)))

    def in_statement(table: Column) -> Column:
        checks = [
            F.when(~table["rest"].rlike(text.java_regex(fixed.TABLE_PROPERTY[0] + tag.lower() + fixed.TABLE_PROPERTY[1], dotall=True)), F.lit(tag))
            for tag in tags
        ]
        missing = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        return row(table["name"], missing)

    def in_match(name: Column) -> Column:
        return row(name, F.array(*[F.lit(tag) for tag in tags]).cast("array<string>"))

    # The rest of the statement is looked at, not consumed, so the next table is still found.
    rest = fixed.TABLE_NAME + r"(?=([^;]*?)(?:;|CREATE TABLE|\z))"
    scan = {"tables": code_matches(fixed.TABLE_NAME, 1, needs=["create table"])}
    if statement:
        scan["rests"] = code_matches(rest, 2, needs=["create table"], dotall=True)
    scan["comment"] = text.contains_any(F.col("folded"), ["owner", "classification", "purpose"]) & code_has(
        text.first_on_line(fixed.OWNER_COMMENT), needs=["#"]
    )

    def rows(m: dict) -> Column:
        if statement:
            both = F.zip_with(m["tables"], m["rests"], lambda name, rest: F.struct(name.alias("name"), rest.alias("rest")))
            found = each(both, in_statement)
        else:
            found = each(m["tables"], in_match)
        by_comment = F.when(m["comment"], passed(fixed.TAG_COMMENT_OK)).otherwise(failed(fixed.TAG_COMMENT_BAD))
        return F.when(F.size(m["tables"]) > 0, found).otherwise(F.array(by_comment))

    return Check(rows, scan)


RULES = [
    Rule(fixed.GOVERNANCE, "unity_catalog_usage", fixed.LABEL_CATALOG, CODE, metastore),
    Rule(fixed.GOVERNANCE, "documentation_and_comments", fixed.LABEL_COMMENTS, CODE, comments),
    Rule(fixed.GOVERNANCE, "version_control_integration", fixed.LABEL_VERSION_CONTROL, CODE, version_control),
    Rule(fixed.GOVERNANCE, "data_isolation", fixed.LABEL_ISOLATION, CODE, isolation),
    Rule(fixed.GOVERNANCE, "metadata_tagging", fixed.LABEL_TAGGING, CODE, tagging),
]
