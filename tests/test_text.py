"""Patterns must find in Spark what they find in a Unicode-aware regex engine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cellaudit.functions import fixed, text
from cellaudit.operators.rules import performance, quality

EDGES = [
    "SELECT\u00a0*", "SELECT\x0b*", "SELECT\x1c*", "SELECT\u3000*", "SELECT\u200b*", "select\t\n *", "\u017felect *", "SELECT*",
    "bearer grüße1", "BEARER\u2003x", "Bearer ", "dapi\u00e9\u4e00x", "password='a' PASSWORD = \"b\" password=''",
    "dev/a\rstaging/b", "dev/a\nstaging/b", "dev/a\u2028staging/b", "staging/ prod", "prod/ dev/", "dev/x prod",
    "ädbfs x", "dbfs_x", "/dbfs/", "hive_metastore", "xhive_metastore.", "DBFS:", "dbf\u017f",
    "nvarchar(3)", "CHAR (10) varchar\n(\u0663)", "char()", "varchar(10)char(2)",
    "CREATE TABLE t (a INT, b DECIMAL(10,2), c DATE)", "create table if not exists t\n(x string not null)",
    "CREATE TABLE a CREATE TABLE b (y int)", "CREATE TABLE t (", "CREATE TABLE t )(a int)", "CREATE TABLE ((a int) b)",
    "CREATE TABLE grüße (größe INT)", "CREATE  TABLE t (a int)",
    "CREATE VIEW v AS SELECT * FROM a; CREATE TEMPORARY VIEW w AS SELECT x", "CREATE OR REPLACE VIEW v AS SELECT * FROM a",
    "CREATE VIEW a.b.c AS\nSELECT 1\n\n", "create view v as select * from a", "CREATE VIEW v SELECT *; x AS SELECT 2;",
    "for i in df.iterrows():", "for x\nin df.iterrows()", "for for iterrows() iterrows()", "iterrows() for", "FOR r IN d.ITERROWS() # for iterrows()",
    "%run ../repos/x", "%run a\nrepos", "dbutils.notebook.run('x') # Repos", "repos %run",
    "# the owner", "#\nowner", "x # y # Business Owner", "owner # none", "# PURPOSE\r owner", "GRANT", "immigrants", "revo\u212ae", "use catalog x",
    "df.cache()", ".CACHE()", "cache\u00a0table", "cache table", "partitioned by", "CLUSTERED  BY", "", "\n\n", "ı i I İ",
    "dbutils.notebook.run('/a') dbutils.notebook.run( \"./b\")", "dbutils.notebook.run('')",
]


def random_texts(n=300):
    """Snippets of edge strings glued together, with line ends of every kind."""
    rng = random.Random(7)
    glue = ["", " ", "\n", "\r", "\u2028", ";", "#", "for ", "dev/", ")", "("]
    return ["".join(rng.choice(EDGES) + rng.choice(glue) for _ in range(rng.randint(1, 6))) for _ in range(n)]


TEXTS = EDGES + random_texts()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, code string").withColumn("folded", text.fold(F.col("code"))).cache()


def collected(texts, column):
    return [r[1] for r in sorted(texts.select("i", column).collect())]


def expected(pattern, group=0, flags=re.IGNORECASE):
    return [[m.group(group) or "" for m in re.finditer(pattern, t, flags)] for t in TEXTS]


PLAIN = [
    fixed.CHARACTER_TYPE, fixed.CREATE_TABLE, fixed.NOTEBOOK_RUN, fixed.SELECT_STAR, fixed.PARTITIONED_OR_CLUSTERED, fixed.ITERROWS_LOOP,
    fixed.CACHING, *fixed.SECRETS, fixed.GRANTS, fixed.OLD_METASTORE, fixed.REPO_RUN, fixed.ENVIRONMENT_PATH, fixed.MIXED_ENVIRONMENTS,
    fixed.TABLE_NAME, fixed.OWNER_COMMENT, fixed.TABLE_COLUMN, r"[\w\s]+x", r"[^\W\d]+", r"\S+\d", r"[]a]", r"[[b]",
]


@pytest.mark.parametrize("pattern", PLAIN)
def test_matches(texts, pattern):
    assert collected(texts, text.find_all(F.col("code"), pattern)) == expected(pattern)


@pytest.mark.parametrize("pattern", PLAIN[:18])
def test_counts_in_folded_text(texts, pattern):
    count = F.regexp_count("folded", F.lit(text.folded_regex(pattern)))
    assert collected(texts, count) == [len(m) for m in expected(pattern)]


@pytest.mark.parametrize("group", [1, 2, 3])
def test_column_groups(texts, group):
    assert collected(texts, text.find_all(F.col("code"), fixed.TABLE_COLUMN, group)) == expected(fixed.TABLE_COLUMN, group)


def test_table_bodies_without_backtracking(texts):
    """The same bodies; empty ones declare nothing and are left out."""
    plain = expected(fixed.TABLE_BODY, 1, re.IGNORECASE | re.DOTALL)
    assert collected(texts, quality.table_bodies()) == [[body for body in bodies if body] for bodies in plain]


def test_views_without_backtracking(texts):
    """Same views, in the same order, with the same verdict on each."""
    plain = expected(fixed.VIEW_BODY, 1, re.IGNORECASE | re.DOTALL)
    bodies = F.regexp_extract_all("folded", F.lit(text.folded_regex(performance.VIEW_BODY, dotall=True)), F.lit(1))
    found = collected(texts, bodies)
    assert [["select *" in b for b in f] for f in found] == [["SELECT *" in b.upper() for b in p] for p in plain]


@pytest.mark.parametrize("pattern", [fixed.ITERROWS_LOOP, fixed.OWNER_COMMENT, *fixed.REPO_RUN.split("|"), *fixed.MIXED_ENVIRONMENTS.strip("()").split("|")])
def test_one_search_per_line(texts, pattern):
    count = F.regexp_count("folded", F.lit(text.folded_regex(text.first_on_line(pattern))))
    assert collected(texts, count) == [len(m) for m in expected(pattern)]


def test_strip_removes_what_str_strip_removes(spark):
    values = [f"{chr(c)}a b{chr(c)}" for c in [*range(0, 0x100), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert [r[1] for r in sorted(df.select("i", text.strip(F.col("v"))).collect())] == [v.strip() for v in values]


def test_percent_text_is_what_printf_prints(spark):
    pairs = [(c, n) for n in [*range(1, 260), 400, 800, 1000, 2000] for c in range(0, n + 1, 1 if n < 260 else 1)]
    df = spark.createDataFrame(pairs, "c int, n int")
    rows = df.select("c", "n", text.percent_text(F.col("c") / F.col("n"))).collect()
    wrong = [(c, n, t, f"{c / n:.1%}") for c, n, t in rows if t != f"{c / n:.1%}"]
    assert wrong == []


def test_literals():
    assert text.literals(fixed.CACHING) == [".cache()", "cache table"]
    assert text.literals(fixed.GRANTS) == ["grant", "revoke", "use catalog"]
    for pattern in (fixed.SELECT_STAR, fixed.CHARACTER_TYPE, fixed.TABLE_NAME, "a.b", "(a|b)"):
        with pytest.raises(ValueError):
            text.literals(pattern)


@pytest.mark.parametrize("pattern", [fixed.CREATE_TABLE, fixed.PARTITIONED_OR_CLUSTERED, fixed.CACHING, fixed.GRANTS, fixed.ENVIRONMENT_PATH])
def test_words_instead_of_patterns(texts, pattern):
    found = collected(texts, text.contains_any(F.col("folded"), text.literals(pattern)))
    assert found == [bool(m) for m in expected(pattern)]
