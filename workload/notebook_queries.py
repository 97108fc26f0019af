"""Queries on the notebook corpus: sources, cells, rules and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellaudit.functions import fixed, shared
from cellaudit.functions.rows import kept, repeated
from cellaudit.operators import cells, engine
from cellaudit.operators.catalog import DEFAULT_CATALOG, attach_severity, enable_rules, rule_catalog
from cellaudit.operators.extend import python_rule, register_rule
from cellaudit.operators.rules import failed, passed
from cellaudit.sources import notebooks as source

from . import oracle as o
from .fixture import corpus, notebook_path, table
from .registry import query

SHOWN = ["rule", "status", "details", "notebook_path", "audit_id", "domain", "rule_key", "severity", "seq"]


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.parse_notebooks(corpus(spark, sf_dir))


def intact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable notebooks whose code can be put together."""
    fine = F.col("readable") & engine.code_problem().isNull()
    return kept(parsed(spark, sf_dir), fine, "path", "cells", "cells_problem")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intact notebooks all of whose titles can be read as well."""
    return kept(intact(spark, sf_dir), engine.title_problem().isNull(), "path", "cells")


INTACT = "readable AND code_problem IS NULL"


# ---- sources -------------------------------------------------------------------------
@query(
    "src1_load_notebooks",
    f"{o.WITH} SELECT path, readable, CASE WHEN {INTACT} THEN sha256(code) END AS code_sha FROM nb",
)
def src1(spark, sf_dir):
    """Exported notebooks as base64 text, decoded, parsed and put together."""
    exported = corpus(spark, sf_dir).select("path", F.base64(F.encode("content", "UTF-8")).alias("content_b64"))
    books = engine.prepared(source.decode_notebooks(exported))
    fine = F.col("readable") & engine.code_problem().isNull()
    return books.select("path", "readable", F.when(fine, F.sha2("code", 256)).alias("code_sha"))


@query(
    "src1_load_notebook_files",
    f"{o.WITH} SELECT path, readable, CASE WHEN {INTACT} THEN sha256(code) END AS code_sha FROM nb",
)
def src1_files(spark, sf_dir):
    """Every notebook written as a file of its own, in folders by user, and read back from two patterns."""
    location = shared.new_location(spark, "exports")
    user = F.regexp_extract("path", "/u([0-9]+)/", 1).cast("int")
    half = F.when(user < 10, "low").otherwise("high")
    source.write_notebook_files(corpus(spark, sf_dir).select("path", "content", half.alias("half"), user.alias("user")), location, "half", "user")
    books = source.load_notebook_files(spark, f"{location}/half=low/user=*", f"{location}/half=h*/*", suffix=".txt")
    found = engine.prepared(books.select(source.written_path().alias("path"), "content"))
    fine = F.col("readable") & engine.code_problem().isNull()
    return found.select("path", "readable", F.when(fine, F.sha2("code", 256)).alias("code_sha"))


CHOSEN = ["/Workspace/Users/u0/nb0", "/Users/u7/nb7", "/Users/u11/nb111", "/Users/u1/nb1"]


@query(
    "src2_select_paths",
    f"{o.WITH} SELECT path, language FROM nb WHERE path IN ({', '.join(o.lit(p) for p in CHOSEN)})",
)
def src2(spark, sf_dir):
    return source.parse_notebooks(source.select_paths(corpus(spark, sf_dir), CHOSEN)).select("path", "language")


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of wanted notebooks as people write it: padded lines, blank lines,
    long notebooks twice, some without the workspace prefix, some that do not exist."""
    d = F.col("doc_id")
    path = notebook_path(d)
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    lines = documents.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("lang") == "en", F.concat(F.lit("  "), path, F.lit("\t"))),
                    F.when((F.col("lang") == "en") & (F.col("n_chars") > 2000), source.normalize_path(path)),
                    F.when((F.col("lang") == "en") & (F.col("n_chars") > 4000), path),
                    F.when(F.col("lang") == "de", F.lit("   ")),
                    F.when(F.col("source") == "src3", F.concat(F.lit("/Users/none/"), d.cast("string"))),
                    F.when((F.col("source") == "src3") & (F.col("n_chars") > 2000), F.concat(F.lit("/Users/none/"), d.cast("string"))),
                )
            )
        ).alias("value")
    )
    location = shared.new_location(spark, "requests")
    lines.write.text(location)
    return source.paths_from_file(spark, location)


REQUESTED = f"""requested AS (
  SELECT path FROM nb JOIN documents ON doc_id = d WHERE lang = 'en'
  UNION ALL SELECT replace(path, '/Workspace/', '/') FROM nb JOIN documents ON doc_id = d WHERE lang = 'en' AND n_chars > 2000
  UNION ALL SELECT path FROM nb JOIN documents ON doc_id = d WHERE lang = 'en' AND n_chars > 4000
  UNION ALL SELECT '/Users/none/' || doc_id FROM documents WHERE source = 'src3'
  UNION ALL SELECT '/Users/none/' || doc_id FROM documents WHERE source = 'src3' AND n_chars > 2000),
numbered AS (SELECT path, replace(path, '/Workspace/', '/') AS key, row_number() OVER (PARTITION BY path) AS copy FROM requested),
corpus AS (SELECT *, replace(path, '/Workspace/', '/') AS key FROM nb)"""


@query(
    "src3_paths_from_file",
    f"{o.WITH}, {REQUESTED} SELECT n.path, n.copy::INT AS copy, language FROM numbered n JOIN corpus c USING (key) WHERE readable",
)
def src3(spark, sf_dir):
    wanted = source.load_requested(corpus(spark, sf_dir), request_lines(spark, sf_dir))
    return repeated(kept(source.parse_notebooks(wanted), F.col("readable"), "path", "copies", "language"), ["path"])


@query("src4_normalize_path", f"{o.WITH} SELECT path, replace(path, '/Workspace/', '/') AS key FROM nb")
def src4(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", source.normalize_path(F.col("path")).alias("key"))


@query(
    "src5_notebook_exists",
    f"{o.WITH}, {REQUESTED} SELECT DISTINCT path, key IN (SELECT key FROM corpus) AS present FROM numbered",
)
def src5(spark, sf_dir):
    return source.notebook_exists(corpus(spark, sf_dir), request_lines(spark, sf_dir))


@query(
    "src6_notebook_access_failures",
    f"""{o.WITH}, {REQUESTED},
    failures AS (
      SELECT n.path, n.copy, {o.lit(fixed.ACCESS_PREFIX)} || n.path || ': ' || {o.lit(fixed.ACCESS_UNREADABLE)} || n.path AS details
      FROM numbered n JOIN corpus c USING (key) WHERE NOT readable
      UNION ALL
      SELECT path, copy, {o.lit(fixed.ACCESS_PREFIX)} || path || ': ' || {o.lit(fixed.ACCESS_MISSING)} || path
      FROM numbered WHERE key NOT IN (SELECT key FROM corpus))
    SELECT path AS notebook_path, {o.lit(fixed.ACCESS_LABEL)} AS rule, 'Failed' AS status, details,
      {o.audit_id(copy="copy::VARCHAR", domain="NULL", key="'notebook_access'", rule=o.lit(fixed.ACCESS_LABEL), seq="0")} AS audit_id FROM failures""",
)
def src6(spark, sf_dir):
    findings = engine.validate_requested(corpus(spark, sf_dir), request_lines(spark, sf_dir))
    access = findings.filter(F.col("rule") == fixed.ACCESS_LABEL)
    return access.select("notebook_path", "rule", "status", "details", "audit_id")


# ---- projections ---------------------------------------------------------------------
N_CELLS = f"CASE WHEN k = {o.fx.CELLS_OBJECT} OR NOT readable THEN 0 ELSE 5 END"


@query(
    "prj1_parse_notebook",
    f"{o.WITH} SELECT path, readable, CASE WHEN readable THEN language END AS language, 'JUPYTER' AS format, {N_CELLS}::INT AS n_cells FROM nb",
)
def prj1(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", "readable", "language", "format", F.size("cells").alias("n_cells"))


@query("prj2_notebook_language", f"{o.WITH} SELECT language, count(*) AS notebooks FROM nb WHERE readable GROUP BY language")
def prj2(spark, sf_dir):
    read = kept(parsed(spark, sf_dir), F.col("readable"), "language")
    return read.groupBy("language").agg(F.count(F.lit(1)).alias("notebooks"))


HEAD_TEXT = "CASE d % 3 WHEN 0 THEN '# Header' WHEN 1 THEN '# Notebook' ELSE '' END"
IGNORED_TEXT = o.lit(o.fx.IGNORED)


@query(
    "prj3_explode_cells",
    f"""{o.WITH} SELECT path, p.pos::INT AS pos,
      CASE WHEN p.pos IN (1, 2, 3) THEN 'code' ELSE 'markdown' END AS cell_type,
      sha256(CASE p.pos WHEN 0 THEN {HEAD_TEXT} WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN text ELSE {IGNORED_TEXT} END) AS text_sha,
      CASE WHEN p.pos = 1 THEN CASE d % 4 WHEN 2 THEN '  ' ELSE title END END AS title
    FROM nb, (SELECT unnest(range(5)) AS pos) p WHERE {INTACT} AND title_problem IS NULL""",
)
def prj3(spark, sf_dir):
    books = titled(spark, sf_dir)
    exploded = cells.explode_cells(books)
    joined = F.coalesce(F.array_join("source", "\n"), F.lit(""))
    return exploded.select("path", "pos", "cell_type", F.sha2(joined, 256).alias("text_sha"), "title")


@query("prj4_code_cells", f"{o.WITH} SELECT path, 3::INT AS n, sha256(a || b || text) AS sha FROM nb WHERE {INTACT}")
def prj4(spark, sf_dir):
    code = cells.code_cells(F.col("cells"))
    joined = F.array_join(F.transform(code, cells.cell_text), "")
    return intact(spark, sf_dir).select("path", F.size(code).alias("n"), F.sha2(joined, 256).alias("sha"))


@query(
    "prj5_markdown_cells",
    f"{o.WITH} SELECT path, 2::INT AS n, {HEAD_TEXT} || '|' || {IGNORED_TEXT} AS text FROM nb WHERE {INTACT}",
)
def prj5(spark, sf_dir):
    found = cells.markdown_cells(F.col("cells"))
    joined = F.array_join(F.transform(found, cells.cell_text), "|")
    return intact(spark, sf_dir).select("path", F.size(found).alias("n"), joined.alias("text"))


@query("prj6_all_code", f"{o.WITH} SELECT path, code FROM nb WHERE {INTACT}")
def prj6(spark, sf_dir):
    return intact(spark, sf_dir).select("path", cells.all_code(F.col("cells")).alias("code"))


def conversation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells stored as rows: conversations, the assistant's turns being code."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"),
        F.col("turn").cast("int").alias("pos"),
        F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"),
        F.split("text", "\n").alias("source"),
    )


@query(
    "prj6_all_code_long",
    "SELECT conv_id::VARCHAR AS path, string_agg(text, chr(10) ORDER BY turn) AS code FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
)
def prj6_long(spark, sf_dir):
    return cells.all_code_from_long(conversation_cells(spark, sf_dir))


@query("prj7_cell_titles", f"{o.WITH} SELECT path, title FROM nb WHERE {INTACT} AND title_problem IS NULL AND title IS NOT NULL")
def prj7(spark, sf_dir):
    books = titled(spark, sf_dir)
    return books.select("path", F.explode(cells.cell_titles(F.col("cells"))).alias("title"))


@query(
    "prj8_first_n_cells",
    f"{o.WITH} SELECT path, 'markdown,code' AS types, {HEAD_TEXT} || chr(10) || a AS text FROM nb WHERE {INTACT}",
)
def prj8(spark, sf_dir):
    head = cells.first_n_cells(F.col("cells"), 2)
    types = F.array_join(F.transform(head, lambda cell: cell["cell_type"]), ",")
    return intact(spark, sf_dir).select("path", types.alias("types"), F.array_join(F.transform(head, cells.cell_text), "\n").alias("text"))


@query(
    "prj9_line_stats",
    f"""{o.WITH} SELECT path, total::INT AS total_lines, commented::INT AS comment_lines,
      CASE WHEN total > 0 THEN {o.RATIO} END AS comment_ratio FROM {o.COUNTED} WHERE {INTACT}""",
)
def prj9(spark, sf_dir):
    return cells.line_stats(cells.with_code(intact(spark, sf_dir)), fixed.COMMENT_STARTS)


# ---- the rules -----------------------------------------------------------------------
RULE_QUERIES = {
    "r01_valid_languages": "valid_languages_only",
    "r02_header_section": "header_section_exists",
    "r03a_missing_titles": "descriptive_cell_titles",
    "r04_string_data_types": "string_data_types",
    "r05_column_nullability": "column_nullability",
    "r07_relative_references": "relative_notebook_references",
    "r08_avoid_select_star": "avoid_select_star",
    "r09_partitioning": "partitioning_and_clustering",
    "r11_python_vectorization": "python_vectorization",
    "r12_cache_usage": "cache_usage",
    "r13_views_explicit_columns": "views_explicit_columns",
    "r14_no_hard_coded_secrets": "no_hard_coded_secrets",
    "r15_access_controls": "access_controls",
    "r17_unity_catalog_usage": "unity_catalog_usage",
    "r18_documentation_and_comments": "documentation_and_comments",
    "r19_version_control": "version_control_integration",
    "r20_data_isolation": "data_isolation",
    "r21_metadata_tagging": "metadata_tagging",
}


def rule_findings(spark, sf_dir, rule_key: str, **parameters) -> DataFrame:
    catalog = enable_rules(DEFAULT_CATALOG, only=[rule_key], parameters={rule_key: parameters})
    findings = engine.validate(corpus(spark, sf_dir), catalog).filter(F.col("rule_key") == rule_key)
    return findings.select("notebook_path", "rule", "status", "details", "seq")


for _name, _key in RULE_QUERIES.items():
    query(_name, o.rule_sql(_key))(lambda spark, sf_dir, key=_key: rule_findings(spark, sf_dir, key))


@query("r14_secrets_in_real_text", o.rule_sql("no_hard_coded_secrets", o.secrets([o.TOKEN])))
def r14_token(spark, sf_dir):
    """A pattern of one's own that hits the documents' own text."""
    return rule_findings(spark, sf_dir, "no_hard_coded_secrets", regex_patterns=[o.TOKEN])


@query("r21_metadata_tagging_statement", o.rule_sql("metadata_tagging", o.TAGGING_STATEMENT))
def r21_statement(spark, sf_dir):
    return rule_findings(spark, sf_dir, "metadata_tagging", metadata_scope="statement")


NAMING = {"table_names": "^(prod|dev|test)_.*", "column_names": "^[A-Z][a-zA-Z0-9]*$"}
REQUIRED, DISALLOWED = ["ENCRYPTED", "MASKED"], ["SHOW TABLES", "GRANT"]


def _naming_sql(what: str, pattern: str, value: str, source_: str, position: str) -> str:
    hit = f"regexp_matches({value}, {o.lit(pattern)})"
    return (
        f"SELECT path, readable, code_problem, CASE WHEN {hit} THEN 'Passed' ELSE 'Failed' END AS status, "
        f"{o.lit(what + ' ' + chr(39))} || {value} || CASE WHEN {hit} THEN {o.lit(chr(39) + ' matches the naming pattern')} "
        f"ELSE {o.lit(chr(39) + ' does not match ' + pattern)} END AS details, {position} AS p FROM {source_}"
    )


def _word_sql(word: str, present: bool) -> str:
    hit = f"contains(lower(code), {o.lit(word.lower())})"
    good = hit if present else f"NOT {hit}"
    return (
        f"SELECT path, readable, code_problem, CASE WHEN {good} THEN 'Passed' ELSE 'Failed' END AS status, "
        f"CASE WHEN {hit} THEN {o.lit(chr(39) + word + chr(39) + ' found')} ELSE {o.lit(chr(39) + word + chr(39) + ' not found')} END AS details, 0 AS p FROM nb"
    )


R22_PARTS = [
    _naming_sql("Table name", NAMING["table_names"], "m", o.unnested(o.TABLES), "i"),
    _naming_sql("Column name", NAMING["column_names"], "cname", o.COLUMNS, "n"),
    *[_word_sql(word, True) for word in REQUIRED],
    *[_word_sql(word, False) for word in DISALLOWED],
]
R22_SQL = " UNION ALL ".join(f"SELECT *, {i} AS part FROM ({part})" for i, part in enumerate(R22_PARTS))


@query(
    "r22_custom_regex",
    f"""{o.WITH} SELECT path AS notebook_path, 'Company Naming' AS rule, status, details,
      (row_number() OVER (PARTITION BY path ORDER BY part, p) - 1)::INT AS seq
    FROM ({R22_SQL}) WHERE {INTACT}""",
)
def r22(spark, sf_dir):
    from cellaudit.operators.catalog import Setting

    row = Setting(
        fixed.CUSTOM, "company_specific_naming", "Company Naming", "warning",
        parameters={"patterns": NAMING, "require_encryption_keywords": REQUIRED, "disallowed_functions": DISALLOWED},
    )
    findings = engine.validate(corpus(spark, sf_dir), [row]).filter(F.col("rule_key") == row.rule_key)
    return findings.select("notebook_path", "rule", "status", "details", "seq")


# ---- findings ------------------------------------------------------------------------
@query("fnd1_finding", o.all_findings_sql("run-7"))
def fnd1(spark, sf_dir):
    """Every field of a finding but the time, under a run id."""
    return engine.validate(corpus(spark, sf_dir), run_id="run-7").select(*SHOWN)


@query("fnd2_validate", o.all_findings_sql())
def fnd2(spark, sf_dir):
    return engine.validate(corpus(spark, sf_dir)).select(*SHOWN)


@query(
    "fnd3_validate_many",
    f"""{o.WITH}, {REQUESTED}, found AS {o.findings_sql()}
    SELECT n.path AS notebook_path, rule, status, count(*) AS n
    FROM numbered n JOIN (SELECT *, replace(path, '/Workspace/', '/') AS key FROM found) f USING (key)
    WHERE rule <> {o.lit(fixed.ACCESS_LABEL)} GROUP BY ALL""",
)
def fnd3(spark, sf_dir):
    """A list of requested notebooks; one asked for twice is validated twice."""
    findings = engine.validate(source.load_requested(corpus(spark, sf_dir), request_lines(spark, sf_dir)))
    kept = findings.filter(F.col("rule") != fixed.ACCESS_LABEL)
    return kept.groupBy("notebook_path", "rule", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fnd4_domain_error_rows",
    f"{o.WITH}, found AS ({' UNION ALL '.join(o.domain_errors(d) for d in o.DOMAINS)}) SELECT path AS notebook_path, rule, status, details FROM found",
)
def fnd4(spark, sf_dir):
    findings = engine.validate(corpus(spark, sf_dir)).filter(F.col("rule_key") == "domain_error")
    return findings.select("notebook_path", "rule", "status", "details")


SWITCHED = enable_rules(
    DEFAULT_CATALOG, on=["views_explicit_columns", "data_isolation"], off=["avoid_select_star"], off_domains=[fixed.SECURITY]
)


@query(
    "fnd5_enable_rules",
    o.all_findings_sql(
        settings=[row for row in SWITCHED if row.enabled and row.rule_key in o.RULE_SQL],
        domains=[fixed.CODE_QUALITY, fixed.PERFORMANCE, fixed.GOVERNANCE],
    ),
)
def fnd5(spark, sf_dir):
    return engine.validate(corpus(spark, sf_dir), SWITCHED).select(*SHOWN)


CATALOG_ROWS = ", ".join(f"({o.lit(r.rule_key)}, {o.lit(r.severity)}, {o.lit(r.domain)})" for r in DEFAULT_CATALOG)
CATALOG = f"catalog AS (SELECT * FROM (VALUES {CATALOG_ROWS}) AS c(rule_key, severity, domain))"


@query(
    "fnd8_attach_severity",
    f"""{o.WITH}, found AS {o.findings_sql()}, {CATALOG}
    SELECT f.path AS notebook_path, f.rule, f.seq, f.rule_key, c.severity, c.domain FROM found f LEFT JOIN catalog c ON f.rule_key = c.rule_key""",
)
def fnd8(spark, sf_dir):
    bare = engine.validate(corpus(spark, sf_dir)).select("notebook_path", "rule", "seq", "rule_key")
    return attach_severity(bare, rule_catalog(spark))


@query(
    "fnd9_run_validation",
    f"""{o.WITH}, found AS {o.findings_sql()}, chosen AS (SELECT * FROM found WHERE path IN ({', '.join(o.lit(p) for p in CHOSEN)}))
    SELECT 'total' AS level, 'all' AS name, count(*) FILTER (WHERE status = 'Passed') AS passed, count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status = 'Pending') AS pending FROM chosen
    UNION ALL SELECT 'rule', rule, count(*) FILTER (WHERE status = 'Passed'), count(*) FILTER (WHERE status = 'Failed'), count(*) FILTER (WHERE status = 'Pending') FROM chosen GROUP BY rule
    UNION ALL SELECT 'notebook', path, count(*) FILTER (WHERE status = 'Passed'), count(*) FILTER (WHERE status = 'Failed'), count(*) FILTER (WHERE status = 'Pending') FROM chosen GROUP BY path""",
)
def fnd9(spark, sf_dir):
    run = engine.run_validation(corpus(spark, sf_dir), CHOSEN)
    counts = ["passed", "failed", "pending"]
    total = run["total"].select(
        F.lit("total").alias("level"), F.lit("all").alias("name"), *[F.col(f"{c}_results").alias(c) for c in counts]
    )
    by_rule = run["by_rule"].select(F.lit("rule").alias("level"), F.col("rule").alias("name"), *counts)
    by_notebook = run["by_notebook"].select(F.lit("notebook").alias("level"), F.col("notebook_path").alias("name"), *counts)
    return total.unionByName(by_rule).unionByName(by_notebook)


# ---- rules of one's own --------------------------------------------------------------
@query(
    "udx1_register_rule",
    f"""{o.WITH} SELECT path AS notebook_path, 'Code Size' AS rule,
      CASE WHEN length(code) > 3000 THEN 'Failed' ELSE 'Passed' END AS status, length(code) || ' characters' AS details
    FROM nb WHERE {INTACT}""",
)
def udx1(spark, sf_dir):
    size = F.length("code")
    details = F.concat(size.cast("string"), F.lit(" characters"))
    rule = register_rule("code_size", "Code Size", lambda: F.array(F.when(size > 3000, failed(details)).otherwise(passed(details))))
    findings = engine.validate(corpus(spark, sf_dir), [], extra=[rule]).filter(F.col("rule_key") == "code_size")
    return findings.select("notebook_path", "rule", "status", "details")


def longest_word(code: str) -> list[tuple[str, str]]:
    length = max((len(word) for word in code.replace("\n", " ").split(" ")), default=0)
    return [(fixed.FAILED if length > 20 else fixed.PASSED, f"longest word has {length} characters")]


@query(
    "udx2_register_python_rule",
    f"""{o.WITH}, longest AS (
      SELECT path, list_max(list_transform(string_split(replace(code, chr(10), ' '), ' '), lambda w: length(w))) AS n FROM nb WHERE {INTACT})
    SELECT path AS notebook_path, 'Longest Word' AS rule, CASE WHEN n > 20 THEN 'Failed' ELSE 'Passed' END AS status,
      'longest word has ' || n || ' characters' AS details FROM longest""",
)
def udx2(spark, sf_dir):
    rule = python_rule("longest_word", "Longest Word", longest_word)
    findings = engine.validate(corpus(spark, sf_dir), [], extra=[rule]).filter(F.col("rule_key") == "longest_word")
    return findings.select("notebook_path", "rule", "status", "details")
