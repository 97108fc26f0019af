"""Cell-level operators on parsed notebooks.

All of them work inside one notebook row with array functions, so they need no
shuffle.  ``all_code_from_long`` is the form for cells stored as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


# ---- PRJ3 --------------------------------------------------------------------
def explode_cells(notebooks: DataFrame) -> DataFrame:
    """Cells as rows, in order; a notebook without cells keeps one empty row."""
    rows = notebooks.select("path", F.posexplode_outer("cells").alias("pos", "cell"))
    return rows.select("path", "pos", "cell.cell_type", "cell.source", "cell.title")


# ---- PRJ4, PRJ5, PRJ8 ----------------------------------------------------------
def code_cells(cells: Column) -> Column:
    return F.filter(cells, lambda cell: cell["cell_type"] == "code")


def markdown_cells(cells: Column) -> Column:
    return F.filter(cells, lambda cell: cell["cell_type"] == "markdown")


def first_n_cells(cells: Column, n: int = 2) -> Column:
    return F.slice(cells, 1, n)


# ---- PRJ6 --------------------------------------------------------------------
def cell_text(cell: Column) -> Column:
    return F.array_join(cell["source"], "\n")


def all_code(cells: Column) -> Column:
    """Text of the code cells, joined by newlines in cell order."""
    return F.array_join(F.transform(code_cells(cells), cell_text), "\n")


def all_code_from_long(cells: DataFrame) -> DataFrame:
    """The same from one row per cell.

    Only code cells are shuffled, already joined to one string each.  A group is
    the code of one notebook, which has to become one value in any case.
    """
    code = cells.filter(F.col("cell_type") == "code").select("path", "pos", F.array_join("source", "\n").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "part")))
    return code.groupBy("path").agg(F.array_join(ordered["part"], "\n").alias("code"))


# ---- PRJ7 --------------------------------------------------------------------
def cell_titles(cells: Column) -> Column:
    """Trimmed titles of all cells that have one."""
    titles = F.transform(cells, lambda cell: text.strip(F.coalesce(cell["title"], F.lit(""))))
    return F.filter(titles, lambda title: title != "")


# ---- PRJ9 --------------------------------------------------------------------
def written_lines(code: Column) -> Column:
    """Stripped lines that are not blank."""
    lines = F.transform(F.split(code, "\n"), text.strip)
    return F.filter(lines, lambda line: line != "")


def comment_lines(lines: Column, starts: list[str]) -> Column:
    def is_comment(line: Column) -> Column:
        test = F.lit(False)
        for start in starts:
            test = test | F.startswith(line, F.lit(start))
        return test

    return F.filter(lines, is_comment)


def line_stats(notebooks: DataFrame, starts: list[str]) -> DataFrame:
    """Non-blank lines, comment lines and their ratio, per notebook."""
    lined = notebooks.withColumn("lines", written_lines(F.col("code")))
    counted = lined.select(
        "path",
        F.size("lines").alias("total_lines"),
        F.size(comment_lines(F.col("lines"), starts)).alias("comment_lines"),
    )
    return counted.withColumn("comment_ratio", F.try_divide("comment_lines", "total_lines"))


def with_code(notebooks: DataFrame) -> DataFrame:
    """Adds ``code`` and its case-folded form, each computed once per notebook."""
    coded = notebooks.withColumn("code", all_code(F.col("cells")))
    return coded.withColumn("folded", text.fold(F.col("code")))
