"""Performance rules.  Two of them ask a model where the text does not decide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed, text
from .base import CODE, Check, Rule, code_count, code_has_word, each, failed, no_rows, passed, repeat_or


def select_star(p: dict) -> Check:
    """``select_star_exceptions``: literal texts taken out before searching (default none)."""
    stars = code_count(fixed.SELECT_STAR, needs=["select"])
    exceptions = p.get("select_star_exceptions", [])
    if exceptions:
        code = F.col("folded")
        for exception in exceptions:
            code = F.replace(code, F.lit(exception.lower()), F.lit(""))
        stars = F.regexp_count(code, F.lit(text.folded_regex(fixed.SELECT_STAR)))
    return Check(
        lambda m: repeat_or(m["stars"], failed(fixed.SELECT_STAR_BAD), passed(fixed.SELECT_STAR_OK)), {"stars": stars}
    )


def partitions_or_clusters() -> Column:
    return code_has_word(fixed.PARTITIONED_OR_CLUSTERED)


def partitioning(p: dict) -> Check:
    return Check(
        lambda m: F.when(m["found"], F.array(passed(fixed.PARTITIONING_OK))).otherwise(no_rows()),
        {"found": partitions_or_clusters()},
    )


def vectorization(p: dict) -> Check:
    return Check(
        lambda m: repeat_or(m["loops"], failed(fixed.VECTORIZATION_BAD), passed(fixed.VECTORIZATION_OK)),
        {"loops": code_count(text.first_on_line(fixed.ITERROWS_LOOP), needs=["iterrows()"])},
    )


def uses_cache() -> Column:
    return code_has_word(fixed.CACHING)


def cache(p: dict) -> Check:
    return Check(
        lambda m: F.when(m["found"], F.array(passed(fixed.CACHE_OK))).otherwise(no_rows()),
        {"found": uses_cache()},
    )


# Finds the views fixed.VIEW_BODY finds.  A body runs to the next semicolon or to
# the end; the plain form also takes blanks off the end, at quadratic cost.  If no
# body follows a head, none follows a later one: the rest is taken at once, with an
# empty body that is left out.
VIEW_BODY = r"CREATE\s+(?:TEMPORARY\s+)?VIEW\s+(?=\w)(?:(?:\w++.*?AS\s+|\w+?AS\s+)(SELECT[^;]*+)|.*+)"


def views(p: dict) -> Check:
    def row(body: Column) -> Column:
        return F.when(F.contains(body, F.lit("select *")), failed(fixed.VIEW_BAD)).otherwise(passed(fixed.VIEW_OK))

    found = F.regexp_extract_all("folded", F.lit(text.folded_regex(VIEW_BODY, dotall=True)), F.lit(1))
    bodies = F.filter(found, lambda body: body != "")
    some = F.contains(F.col("folded"), F.lit("create")) & F.contains(F.col("folded"), F.lit("view"))
    return Check(
        lambda m: each(m["bodies"], row), {"bodies": F.when(some, bodies).otherwise(F.array().cast("array<string>"))}
    )


RULES = [
    Rule(fixed.PERFORMANCE, "avoid_select_star", fixed.LABEL_SELECT_STAR, CODE, select_star),
    Rule(fixed.PERFORMANCE, "partitioning_and_clustering", fixed.LABEL_PARTITIONING, CODE, partitioning),
    Rule(fixed.PERFORMANCE, "python_vectorization", fixed.LABEL_VECTORIZATION, CODE, vectorization),
    Rule(fixed.PERFORMANCE, "cache_usage", fixed.LABEL_CACHE, CODE, cache),
    Rule(fixed.PERFORMANCE, "views_explicit_columns", fixed.LABEL_VIEWS, CODE, views),
]
