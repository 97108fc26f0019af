"""Code quality rules: language, structure, column types, notebook references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed, text
from ..cells import cell_text, code_cells, first_n_cells
from .base import (
    CODE, HEAD, LANGUAGE, TITLES, Check, Rule, code_count, code_has_word, code_matches, each, failed, no_rows, one, passed, quoted,
)


def valid_languages(p: dict) -> Check:
    allowed = p.get("allowed_languages", ["python", "sql"])
    language = F.col("language")
    bad = F.concat(quoted(fixed.LANGUAGE_BAD, language), F.lit(str(allowed)))
    return Check(lambda _: one(language.isin(allowed), passed(F.concat(F.lit(fixed.LANGUAGE_OK), language)), failed(bad)))


def has_header(cells: Column, p: dict) -> Column:
    """One of the first cells, of any type, names a header keyword."""
    words = p.get("header_keywords", ["header"])
    head = first_n_cells(cells, p.get("header_cells", 2))
    return F.exists(head, lambda cell: text.contains_any(F.lower(cell_text(cell)), words))


def header_section(p: dict) -> Check:
    return Check(
        lambda m: one(m["header"], passed(fixed.HEADER_OK), failed(fixed.HEADER_BAD)),
        from_cells={"header": has_header(F.col("cells"), p)},
    )


def title_of(cell: Column) -> Column:
    return text.strip(F.coalesce(cell["title"], F.lit("")))


def missing_titles(p: dict) -> Check:
    untitled = F.filter(code_cells(F.col("cells")), lambda cell: title_of(cell) == "")
    return Check(
        lambda m: F.array_repeat(failed(fixed.TITLE_MISSING), m["untitled"]), from_cells={"untitled": F.size(untitled)}
    )


def string_types(p: dict) -> Check:
    def rows(m: dict) -> Column:
        count = m["character_types"]
        return (
            F.when(count > 0, F.array(failed(quoted(fixed.STRING_TYPES_BAD, count.cast("string")))))
            .when(m["creates_table"], F.array(passed(fixed.STRING_TYPES_OK)))
            .otherwise(no_rows())
        )

    return Check(rows, {
        "character_types": code_count(fixed.CHARACTER_TYPE, needs=["char"]),
        "creates_table": code_has_word(fixed.CREATE_TABLE),
    })


def table_columns(bodies: Column) -> Column:
    """Columns declared in table bodies: name, type and NOT NULL, in order."""

    def of_body(body: Column) -> Column:
        names, types, markers = [text.find_all(body, TABLE_COLUMN, group) for group in (1, 2, 3)]
        typed = F.zip_with(names, types, lambda name, kind: F.struct(name.alias("name"), kind.alias("type")))
        return F.zip_with(
            typed, markers, lambda column, marker: F.struct(column["name"].alias("name"), column["type"].alias("type"), marker.alias("marker"))
        )

    return F.flatten(F.transform(bodies, of_body))


# Matches what fixed.TABLE_COLUMN matches.  A name starts where a word does, or where
# the match before ended; the plain form tries every character of a long word.
TABLE_COLUMN = r"(?:\G|(?<!\w))(\w++)\s+(STRING|INT|TIMESTAMP|DATE|BIGINT|DECIMAL|BOOLEAN)\s*(NOT NULL)?"

# Matches what fixed.TABLE_BODY matches: the body runs from the first opening
# bracket to the first closing one.  Where there is none, no later head has one
# either, so the rest is taken at once, with an empty body that is left out.
TABLE_BODY = r"CREATE TABLE[^(]*+(?:\(([^)]*+)\)|.*+)"


def table_bodies() -> Column:
    bodies = code_matches(TABLE_BODY, 1, needs=["create table"], dotall=True)
    return F.filter(bodies, lambda body: body != "")


def nullability(p: dict) -> Check:
    def row(column: Column) -> Column:
        loose = (column["marker"] == "") & (F.upper(column["type"]) != "STRING")
        return F.when(loose, failed(quoted(fixed.NULLABILITY_BAD, column["name"]))).otherwise(
            passed(quoted(fixed.NULLABILITY_OK, column["name"]))
        )

    return Check(lambda m: each(table_columns(m["bodies"]), row), {"bodies": table_bodies()})


def notebook_references(p: dict) -> Check:
    def row(path: Column) -> Column:
        return F.when(F.startswith(path, F.lit("/")), failed(quoted(fixed.REFERENCE_BAD, path))).otherwise(
            passed(quoted(fixed.REFERENCE_OK, path))
        )

    return Check(lambda m: each(m["runs"], row), {"runs": code_matches(fixed.NOTEBOOK_RUN, 1, needs=["dbutils.notebook.run"])})


RULES = [
    Rule(fixed.CODE_QUALITY, "valid_languages_only", fixed.LABEL_LANGUAGES, LANGUAGE, valid_languages),
    Rule(fixed.CODE_QUALITY, "header_section_exists", fixed.LABEL_HEADER, HEAD, header_section),
    Rule(fixed.CODE_QUALITY, "descriptive_cell_titles", fixed.LABEL_TITLE, TITLES, missing_titles),
    Rule(fixed.CODE_QUALITY, "string_data_types", fixed.LABEL_STRING_TYPES, CODE, string_types),
    Rule(fixed.CODE_QUALITY, "column_nullability", fixed.LABEL_NULLABILITY, CODE, nullability),
    Rule(fixed.CODE_QUALITY, "relative_notebook_references", fixed.LABEL_REFERENCES, CODE, notebook_references),
]
