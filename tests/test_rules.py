"""What each rule finds, and how many rows it makes of it."""

from tests.helpers import code_cell, code_findings, findings, notebook, statuses

from cellaudit.functions import fixed


def test_valid_languages(spark):
    books = [notebook(language=name) for name in ("Python", "SQL", "scala", "R", "julia")] + ['{"cells": []}']
    rows = findings(spark, "valid_languages_only", books)
    assert [r[0][0] for r in rows] == ["Passed"] * 4 + ["Failed", "Passed"]
    assert rows[4] == [("Failed", "Notebook language 'julia' is not in valid languages: ['sql', 'python', 'scala', 'r']")]
    assert rows[5] == [("Passed", "Notebook uses valid language: python")]


def test_header_in_first_two_cells_of_any_type(spark):
    plain = code_cell("x")
    books = [
        notebook({"cell_type": "markdown", "source": ["# HEADER\n"]}, plain),
        notebook(plain, code_cell("# subheader")),
        notebook(plain, plain, code_cell("# header")),
        notebook(),
        notebook({"cell_type": "raw", "source": "my header"}),
        notebook(code_cell("head", "er")),
    ]
    assert [r[0][0][0] for r in findings(spark, "header_section_exists", books)] == list("PPFFPF")


def test_header_switches(spark):
    books = [notebook(code_cell("a"), code_cell("b"), code_cell("# Purpose"))]
    assert findings(spark, "header_section_exists", books, header_keywords=["purpose"], header_cells=3)[0][0][0] == "Passed"


def test_missing_titles(spark):
    books = [
        notebook(code_cell("a"), code_cell("b", title=" \t "), code_cell("c", title="Load"), {"cell_type": "markdown", "source": []}),
        notebook(code_cell("a", title="x")),
        notebook(),
    ]
    assert [len(r) for r in findings(spark, "descriptive_cell_titles", books)] == [2, 0, 0]


def test_string_types(spark):
    codes = ["nvarchar(3) CHAR (2)", "CREATE TABLE t (a STRING)", "select 1", "char(x)"]
    rows = code_findings(spark, "string_data_types", codes)
    assert rows == [
        [("Failed", "Found 2 VARCHAR/CHAR columns; use STRING instead")],
        [("Passed", "No VARCHAR/CHAR columns found")],
        [],
        [],
    ]


def test_nullability(spark):
    codes = [
        "CREATE TABLE t (id INT NOT NULL, n STRING, amt DECIMAL(10,2), d DATE)",
        "CREATE TABLE t (a INTEGER, b TIMESTAMP_NTZ NOT NULL, c DATETIME not null, e boolean NOT NULL)",
        "CREATE TABLE t AS SELECT 1; CREATE TABLE u (größe BIGINT)",
        "no table (x INT)",
    ]
    rows = code_findings(spark, "column_nullability", codes)
    # a body ends at its first closing bracket, and NOT NULL must directly follow the type
    assert ["".join(s[0] for s, _ in r) for r in rows] == ["PPF", "FFFP", "F", ""]
    assert rows[2] == [("Failed", "Column 'größe' is nullable but not confirmed optional")]


def test_notebook_references(spark):
    rows = code_findings(spark, "relative_notebook_references", ["dbutils.notebook.run('/Shared/a', 60)\ndbutils.notebook.run( \"./b\")", "x"])
    assert rows == [
        [("Failed", "Absolute path '/Shared/a' used; use relative references"), ("Passed", "Relative path './b' used correctly")],
        [],
    ]


def test_select_star(spark):
    assert statuses(spark, "avoid_select_star", ["SELECT *\nselect\t*", "SELECT a.*", "SELECT * FROM (SELECT 1)"]) == ["FF", "P", "F"]
    assert statuses(
        spark, "avoid_select_star", ["select * FROM (SELECT * FROM a)"], select_star_exceptions=["SELECT * FROM (SELECT"]
    ) == ["P"]


def test_rules_a_model_may_have_to_decide(spark):
    assert statuses(spark, "partitioning_and_clustering", ["x Partitioned By (a)", "CLUSTERED BY", "none"]) == ["P", "P", ""]
    assert statuses(spark, "cache_usage", ["df.cache()", "cache table t", "df.cache ()"]) == ["P", "P", ""]


def test_vectorization(spark):
    codes = ["for a in x.iterrows(): pass\nfor b in y.iterrows(): pass", "for a in x:\n y.iterrows()", "for a, for b iterrows() iterrows()"]
    assert statuses(spark, "python_vectorization", codes) == ["FF", "P", "F"]


def test_views(spark):
    codes = [
        "CREATE VIEW v AS SELECT * FROM a;\nCREATE TEMPORARY VIEW w AS SELECT x FROM b",
        "CREATE OR REPLACE VIEW v AS SELECT * FROM a",
        "CREATE VIEW a.b.c AS SELECT  * FROM a",
    ]
    assert statuses(spark, "views_explicit_columns", codes) == ["FP", "", "P"]


def test_secrets_in_pattern_order(spark):
    rows = code_findings(spark, "no_hard_coded_secrets", ["password = 'p' dapi12 bearer  grüße1 dapi3", "clean"])
    found = [d.removeprefix(fixed.SECRET_FOUND) for _, d in rows[0]]
    assert found == ["bearer  grüße1", "dapi12", "dapi3", "password = 'p'"]
    assert rows[1] == []


def test_access_controls_is_a_substring_search(spark):
    assert statuses(spark, "access_controls", ["immigrants", "revoke", "use  catalog"]) == ["P", "P", "F"]


def test_metastore_needs_word_edges(spark):
    assert statuses(spark, "unity_catalog_usage", ["dbfs:/x", "ädbfs", "dbfs_x", "hive_metastore.a", "/DBFS/"]) == ["F", "P", "P", "F", "F"]


def test_comments(spark):
    codes = ["", " \n\t", "# a\nx\n", "\n".join(["x"] * 9 + ["  // c"]), "\n".join(["x"] * 10 + ["/* c"]), "\n".join(["x"] * 351 + ["#"] * 49)]
    rows = code_findings(spark, "documentation_and_comments", codes)
    assert [r[0] for r in rows] == [
        ("Passed", "No code to validate"),
        ("Passed", "No code to validate"),
        ("Passed", "Sufficient comments found (50.0% of lines)"),
        ("Passed", "Sufficient comments found (10.0% of lines)"),
        ("Failed", "Insufficient comments (9.1% of lines, minimum 10.0% required)"),
        ("Passed", "Sufficient comments found (12.2% of lines)"),
    ]


def test_version_control(spark):
    assert statuses(spark, "version_control_integration", ["%run ../Repos/x", "%run x\nrepos", "dbutils.notebook.run('repos')"]) == ["P", "F", "P"]


def test_isolation(spark):
    codes = ["dev/a", "dev/a prod/b", "prod/b dev/a", "staging/a\nprod/b", "x", "dev/a\rstaging/b"]
    assert statuses(spark, "data_isolation", codes) == ["P", "F", "P", "P", "F", "F"]


def test_tagging(spark):
    codes = [
        "CREATE TABLE IF NOT EXISTS t (a INT)",
        "CREATE TABLE a.b.c (x INT) TBLPROPERTIES ('owner' = 'z'); create table d (y int)",
        "# Business Owner: me",
        "x = 1",
    ]
    rows = code_findings(spark, "metadata_tagging", codes)
    missing = "' missing required metadata tags: owner"
    assert rows == [
        [("Failed", "Table 'IF" + missing)],
        [("Failed", "Table 'b" + missing), ("Failed", "Table 'd" + missing)],
        [("Passed", "Metadata information found in comments")],
        [("Failed", "No metadata tags or ownership information found; add TBLPROPERTIES or comments")],
    ]


def test_tagging_switches(spark):
    codes = ["CREATE TABLE a.t (x INT) TBLPROPERTIES ('OWNER' = 'z') create table d (y int); owner ="]
    assert statuses(spark, "metadata_tagging", codes, metadata_scope="statement") == ["PF"]
    assert statuses(spark, "metadata_tagging", codes, required_tags=[]) == ["PP"]
    rows = code_findings(spark, "metadata_tagging", codes, required_tags=["OWNER", "PURPOSE"])
    assert rows[0][0] == ("Failed", "Table 't' missing required metadata tags: OWNER, PURPOSE")
