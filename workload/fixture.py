"""Inputs of the registered queries, derived by Spark from the given tables.

``corpus`` turns every row of ``documents`` into one exported notebook: its
whole text is a code cell, next to short snippets that the rules look for, and
some notebooks are malformed in known ways.  The number of notebooks and the
amount of text grow with the table; nothing is filtered out.

The oracle (``oracle.py``) states the same recipe independently in SQL and never
parses JSON, so reading and unpacking notebooks is checked too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# {d} is the document's id.
SNIPPETS_A = [
    "SELECT * FROM a\nSELECT  * FROM b",
    "SELECT id FROM a",
    "CREATE TABLE s.t{d} (id INT NOT NULL, n VARCHAR(10), c char (3), m nvarchar(5))",
    "CREATE TABLE IF NOT EXISTS t (id BIGINT NOT NULL, amt DECIMAL(10,2), d DATE)",
    "CREATE TABLE a.b.c (x INTEGER, s STRING, ts TIMESTAMP_NTZ NOT NULL, ok BOOLEAN NOT NULL) "
    "PARTITIONED BY (x) TBLPROPERTIES ('owner' = 'z')",
    "CREATE VIEW v AS SELECT * FROM a;\nCREATE TEMPORARY VIEW w AS SELECT x FROM b",
    "CREATE OR REPLACE VIEW v2 AS SELECT * FROM a",
    "for i, r in df.iterrows():\n    pass",
    "df = spark.table('t').cache()",
    "cache table t\n-- clustered by (id)",
    "GRANT SELECT ON t TO g\nUSE CATALOG main",
    "read('hive_metastore.x')\nread('dbfs:/y')",
]
SNIPPETS_B = [
    "h = 'Bearer abc123'",
    "tok = 'dapi0123'\npassword = 'p{d}'",
    "x = 1",
    "dbutils.notebook.run('/Shared/a', 60)\ndbutils.notebook.run( './b', 60)",
    "%run ../repos/common",
    "p = 'dev/a'",
    "p = 'dev/a'; q = 'prod/b'",
    "p = 'prod/b'; q = 'dev/a'",
    "p = 'staging/a'\nq = 'prod/b'",
    "# owner: team\n# note\n// c\ny = 2",
    "",
]
LANGUAGES = ["python", "SQL", "scala", "R", "julia"]  # d % 6; 5 has none
MARKDOWN_HEADS = ["# Header", "# Notebook"]  # d % 3; 2 has no source
TITLES = [None, "Load", "  ", "Build daily revenue table"]  # d % 4
# Markdown that must be ignored although every line would hit a rule.
IGNORED = "SELECT * FROM ignored\nGRANT nothing\nBearer ignored\ndbfs"

# d % 50: how a notebook is malformed.
CUT_SHORT, LIST_ON_TOP, NULL_TITLE, NULL_SOURCE, STRING_SOURCE, MIXED_SOURCE, CELLS_OBJECT, NULL_METADATA = (
    49, 48, 47, 46, 45, 44, 43, 42,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json_text(value: Column) -> Column:
    """A string as a JSON string."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _choose(values: list[str], index: Column, d: Column) -> Column:
    chosen = F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)
    return F.replace(chosen, F.lit("{d}"), d.cast("string"))


def notebook_path(d: Column) -> Column:
    prefix = F.when(d % 5 == 0, F.lit("/Workspace")).otherwise(F.lit(""))
    return F.concat(prefix, F.lit("/Users/u"), (d % 20).cast("string"), F.lit("/nb"), d.cast("string"))


def _cell(kind: str, source: Column, title: Column | None = None) -> Column:
    """JSON of one cell; ``source`` and ``title`` are JSON or null for a missing key."""
    parts = [F.lit(f'{{"cell_type":"{kind}"')]
    if title is not None:
        parts.append(F.coalesce(F.concat(F.lit(',"title":'), title), F.lit("")))
    parts += [F.coalesce(F.concat(F.lit(',"source":'), source), F.lit("")), F.lit("}")]
    return F.concat(*parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, read as they lie."""
    return table(spark, sf_dir, "documents")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``, one notebook per document."""
    return notebooks_from(documents(spark, sf_dir))


def notebooks_from(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    kind = d % 50

    def lines(value: Column) -> Column:
        return F.to_json(F.split(value, "\n"))

    head = F.when(d % 3 == 2, F.lit(None)).otherwise(F.to_json(F.array(_choose(MARKDOWN_HEADS, F.least(d % 3, F.lit(1)), d))))
    title = F.when(kind == NULL_TITLE, F.lit("null")).when(d % 4 == 0, F.lit(None)).otherwise(
        _json_text(_choose([t or "" for t in TITLES], d % 4, d))
    )
    first = _choose(SNIPPETS_A, d % 12, d)
    second = _choose(SNIPPETS_B, d % 11, d)
    cells = F.array(
        _cell("markdown", head),
        _cell("code", F.when(kind == STRING_SOURCE, _json_text(first)).otherwise(lines(first)), title),
        _cell(
            "code",
            F.when(kind == NULL_SOURCE, F.lit("null")).when(kind == MIXED_SOURCE, F.lit('["x = 1",7]')).otherwise(lines(second)),
        ),
        _cell("code", lines(F.col("text"))),
        _cell("markdown", lines(F.lit(IGNORED))),
    )
    language = F.when(d % 6 == 5, F.lit("")).otherwise(
        F.concat(F.lit('"language":"'), _choose(LANGUAGES, F.least(d % 6, F.lit(4)), d), F.lit('"'))
    )
    metadata = F.when(kind == NULL_METADATA, F.lit("null")).otherwise(F.concat(F.lit('{"kernelspec":{'), language, F.lit("}}")))
    joined = F.array_join(cells, ",")
    walls = F.when(kind == CELLS_OBJECT, F.concat(F.lit('{"first":'), cells[1], F.lit("}"))).otherwise(
        F.concat(F.lit("["), joined, F.lit("]"))
    )
    content = F.concat(F.lit('{"metadata":'), metadata, F.lit(',"cells":'), walls, F.lit("}"))
    content = F.when(kind == CUT_SHORT, F.concat(F.lit('{"cells":['), joined)).when(
        kind == LIST_ON_TOP, F.concat(F.lit("["), joined, F.lit("]"))
    ).otherwise(content)
    return documents.select(notebook_path(d).alias("path"), content.alias("content"))
