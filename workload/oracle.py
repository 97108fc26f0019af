"""The notebook corpus and the rules in DuckDB SQL.

Notebooks are stated from ``documents`` directly (see ``fixture``), without JSON,
so every query that starts from a corpus also checks reading and unpacking it.
Patterns are the fixed ones in their plain, backtracking form.
"""

from __future__ import annotations

from cellaudit.functions import fixed as f
from cellaudit.functions import text
from cellaudit.operators.catalog import DEFAULT_CATALOG
from cellaudit.sources.notebooks import BAD_CELLS, BAD_SOURCE

from . import fixture as fx


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return lit(text.portable(pattern))


def array(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(values: list[str], index: str) -> str:
    return f"replace({array(values)}[({index}) + 1], '{{d}}', d::VARCHAR)"


NL = "chr(10)"
NOTEBOOKS = f"""
base AS (SELECT doc_id AS d, text, doc_id % 50 AS k FROM documents),
nb AS (
  SELECT d, k, text,
    CASE WHEN d % 5 = 0 THEN '/Workspace' ELSE '' END || '/Users/u' || (d % 20) || '/nb' || d AS path,
    CASE WHEN d % 6 = 5 THEN 'python' ELSE lower({pick(fx.LANGUAGES, 'd % 6')}) END AS language,
    {pick(fx.SNIPPETS_A, 'd % 12')} AS a,
    {pick(fx.SNIPPETS_B, 'd % 11')} AS b,
    {pick(fx.SNIPPETS_A, 'd % 12')} || {NL} || {pick(fx.SNIPPETS_B, 'd % 11')} || {NL} || text AS code,
    d % 3 = 0 AS has_header,
    CASE d % 4 WHEN 1 THEN {lit(fx.TITLES[1])} WHEN 3 THEN {lit(fx.TITLES[3])} END AS title,
    k NOT IN ({fx.CUT_SHORT}, {fx.LIST_ON_TOP}, {fx.NULL_METADATA}) AS readable,
    CASE k WHEN {fx.CELLS_OBJECT} THEN {lit(BAD_CELLS)} WHEN {fx.NULL_SOURCE} THEN {lit(f.NULL_SOURCE)}
      WHEN {fx.MIXED_SOURCE} THEN {lit(BAD_SOURCE)} END AS code_problem,
    CASE k WHEN {fx.CELLS_OBJECT} THEN {lit(BAD_CELLS)} WHEN {fx.NULL_TITLE} THEN {lit(f.NULL_TITLE)} END AS title_problem,
    CASE k WHEN {fx.CELLS_OBJECT} THEN {lit(BAD_CELLS)} END AS head_problem
  FROM base)"""
WITH = "WITH " + NOTEBOOKS.strip()


def rows(rule: str, status: str, details: str, seq: str = "0", source: str = "nb", where: str = "TRUE") -> str:
    return (
        f"SELECT d, k, path, readable, code_problem, title_problem, head_problem, {lit(rule)} AS rule, "
        f"{status} AS status, {details} AS details, ({seq})::INT AS seq FROM {source} WHERE {where}"
    )


def has(pattern: str, options: str = "i") -> str:
    return f"regexp_matches(code, {re2(pattern)}, '{options}')"


def all_of(pattern: str, group: int = 0, options: str = "i", of: str = "code") -> str:
    return f"regexp_extract_all({of}, {re2(pattern)}, {group}, '{options}')"


def either(condition: str, ok: str, bad: str, label: str) -> str:
    return rows(label, f"CASE WHEN {condition} THEN 'Passed' ELSE 'Failed' END", f"CASE WHEN {condition} THEN {lit(ok)} ELSE {lit(bad)} END")


def unnested(expression: str) -> str:
    """``nb`` with one row per element of a list: ``m`` and its position ``i`` from 0."""
    return f"(SELECT *, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS i FROM (SELECT *, {expression} AS ms FROM nb))"


def per_match_or(pattern: str, ok: str, bad: str, label: str) -> str:
    matched = rows(label, "'Failed'", lit(bad), "i", unnested(all_of(pattern)))
    return f"{matched} UNION ALL {rows(label, chr(39) + 'Passed' + chr(39), lit(ok), where='NOT ' + has(pattern))}"


def around(pair: tuple[str, ...], value: str) -> str:
    return f"{lit(pair[0])} || {value} || {lit(pair[1])}"


ALLOWED = ["sql", "python", "scala", "r"]
LANGUAGES = rows(
    f.LABEL_LANGUAGES,
    f"CASE WHEN list_contains({array(ALLOWED)}, language) THEN 'Passed' ELSE 'Failed' END",
    f"CASE WHEN list_contains({array(ALLOWED)}, language) THEN {lit(f.LANGUAGE_OK)} || language "
    f"ELSE {around(f.LANGUAGE_BAD, 'language')} || {lit(str(ALLOWED))} END",
)
HEADER = either("has_header", f.HEADER_OK, f.HEADER_BAD, f.LABEL_HEADER)
# Three code cells; only the first can have a title.
TITLE = rows(
    f.LABEL_TITLE, "'Failed'", lit(f.TITLE_MISSING), "i",
    "(SELECT *, unnest(range(CASE WHEN title IS NULL THEN 3 ELSE 2 END)) AS i FROM nb)",
)
CHARACTERS = f"len({all_of(f.CHARACTER_TYPE)})"
STRING_TYPES = rows(
    f.LABEL_STRING_TYPES,
    f"CASE WHEN {CHARACTERS} > 0 THEN 'Failed' ELSE 'Passed' END",
    f"CASE WHEN {CHARACTERS} > 0 THEN {around(f.STRING_TYPES_BAD, CHARACTERS)} ELSE {lit(f.STRING_TYPES_OK)} END",
    where=f"{CHARACTERS} > 0 OR {has(f.CREATE_TABLE)}",
)
COLUMNS = f"""(SELECT *, row_number() OVER (PARTITION BY d ORDER BY i, j) - 1 AS n FROM (
  SELECT *, unnest({all_of(f.TABLE_COLUMN, 1, of='m')}) AS cname, unnest({all_of(f.TABLE_COLUMN, 2, of='m')}) AS ctype,
    unnest({all_of(f.TABLE_COLUMN, 3, of='m')}) AS marker, generate_subscripts({all_of(f.TABLE_COLUMN, 1, of='m')}, 1) AS j
  FROM {unnested(all_of(f.TABLE_BODY, 1, 'is'))}))"""
LOOSE = "coalesce(marker, '') = '' AND upper(ctype) <> 'STRING'"
NULLABILITY = rows(
    f.LABEL_NULLABILITY,
    f"CASE WHEN {LOOSE} THEN 'Failed' ELSE 'Passed' END",
    f"CASE WHEN {LOOSE} THEN {around(f.NULLABILITY_BAD, 'cname')} ELSE {around(f.NULLABILITY_OK, 'cname')} END",
    "n", COLUMNS,
)
REFERENCES = rows(
    f.LABEL_REFERENCES,
    "CASE WHEN m LIKE '/%' THEN 'Failed' ELSE 'Passed' END",
    f"CASE WHEN m LIKE '/%' THEN {around(f.REFERENCE_BAD, 'm')} ELSE {around(f.REFERENCE_OK, 'm')} END",
    "i", unnested(all_of(f.NOTEBOOK_RUN, 1)),
)
SELECT_STAR = per_match_or(f.SELECT_STAR, f.SELECT_STAR_OK, f.SELECT_STAR_BAD, f.LABEL_SELECT_STAR)
PARTITIONING = rows(f.LABEL_PARTITIONING, "'Passed'", lit(f.PARTITIONING_OK), where=has(f.PARTITIONED_OR_CLUSTERED))
VECTORIZATION = per_match_or(f.ITERROWS_LOOP, f.VECTORIZATION_OK, f.VECTORIZATION_BAD, f.LABEL_VECTORIZATION)
CACHE = rows(f.LABEL_CACHE, "'Passed'", lit(f.CACHE_OK), where=has(f.CACHING))
VIEWS = rows(
    f.LABEL_VIEWS,
    "CASE WHEN contains(upper(m), 'SELECT *') THEN 'Failed' ELSE 'Passed' END",
    f"CASE WHEN contains(upper(m), 'SELECT *') THEN {lit(f.VIEW_BAD)} ELSE {lit(f.VIEW_OK)} END",
    "i", unnested(all_of(f.VIEW_BODY, 1, "is")),
)


def secrets(patterns: list[str]) -> str:
    matches = " || ".join(all_of(p) for p in patterns)
    return rows(f.LABEL_SECRETS, "'Failed'", f"{lit(f.SECRET_FOUND)} || m", "i", unnested(f"({matches})"))


SECRETS = secrets(f.SECRETS)
TOKEN = r"""token\s*=\s*['"][^'"]+['"]"""
ACCESS = either(has(f.GRANTS), f.ACCESS_OK, f.ACCESS_BAD, f.LABEL_ACCESS_CONTROLS)
# RE2's \b is ASCII-only, so the word edges are spelled out.
METASTORE_HIT = f"regexp_matches(code, '(^|[^{text.WORD}])(hive_metastore|dbfs)($|[^{text.WORD}])', 'i')"
METASTORE = either(f"NOT {METASTORE_HIT}", f.CATALOG_OK, f.CATALOG_BAD, f.LABEL_CATALOG)
LINES = f"list_transform(string_split(code, {NL}), lambda x: trim(x, {lit(text.BLANKS)}))"
TOTAL = f"len(list_filter({LINES}, lambda x: x <> ''))"
STARTS = " OR ".join(f"starts_with(x, {lit(s)})" for s in f.COMMENT_STARTS)
COMMENTED = f"len(list_filter({LINES}, lambda x: {STARTS}))"
COUNTED = f"(SELECT *, {TOTAL} AS total, {COMMENTED} AS commented FROM nb)"
RATIO = "(commented::DOUBLE / total::DOUBLE)"
SHARE = f"printf('%.1f%%', {RATIO} * 100.0)"
COMMENTS = rows(
    f.LABEL_COMMENTS,
    f"CASE WHEN total = 0 OR {RATIO} >= 0.1::DOUBLE THEN 'Passed' ELSE 'Failed' END",
    f"CASE WHEN total = 0 THEN {lit(f.COMMENTS_NONE)} WHEN {RATIO} >= 0.1::DOUBLE THEN {around(f.COMMENTS_OK, SHARE)} "
    f"ELSE {lit(f.COMMENTS_BAD[0])} || {SHARE} || {lit(f.COMMENTS_BAD[1] + '10.0%' + f.COMMENTS_BAD[2])} END",
    source=COUNTED,
)
VERSION_CONTROL = either(has(f.REPO_RUN), f.VERSION_CONTROL_OK, f.VERSION_CONTROL_BAD, f.LABEL_VERSION_CONTROL)
ISOLATION = either(
    f"({has(f.ENVIRONMENT_PATH)} AND NOT {has(f.MIXED_ENVIRONMENTS)})", f.ISOLATION_OK, f.ISOLATION_BAD, f.LABEL_ISOLATION
)
TABLES = all_of(f.TABLE_NAME, 1)
BY_COMMENT = rows(
    f.LABEL_TAGGING,
    f"CASE WHEN {has(f.OWNER_COMMENT)} THEN 'Passed' ELSE 'Failed' END",
    f"CASE WHEN {has(f.OWNER_COMMENT)} THEN {lit(f.TAG_COMMENT_OK)} ELSE {lit(f.TAG_COMMENT_BAD)} END",
    where=f"len({TABLES}) = 0",
)
TAGGING = f"{rows(f.LABEL_TAGGING, chr(39) + 'Failed' + chr(39), around(f.TAGS_BAD, 'm') + ' || ' + lit('owner'), 'i', unnested(TABLES))} UNION ALL {BY_COMMENT}"
# The fixture's tables each stand in a statement of their own.
STATEMENT_HIT = f"regexp_matches(regexp_extract(code, {re2(f.TABLE_NAME + '([^;]*)')}, 2, 'i'), {re2(f.TABLE_PROPERTY[0] + 'owner' + f.TABLE_PROPERTY[1])}, 'is')"
TAGGING_STATEMENT = (
    rows(
        f.LABEL_TAGGING,
        f"CASE WHEN {STATEMENT_HIT} THEN 'Passed' ELSE 'Failed' END",
        f"CASE WHEN {STATEMENT_HIT} THEN {around(f.TAGS_OK, 'm')} ELSE {around(f.TAGS_BAD, 'm')} || 'owner' END",
        "i", unnested(TABLES),
    )
    + " UNION ALL " + BY_COMMENT
)

# rule key -> (SQL, what it reads: no_problem column that must be null)
RULE_SQL = {
    "valid_languages_only": (LANGUAGES, None),
    "header_section_exists": (HEADER, "head_problem"),
    "descriptive_cell_titles": (TITLE, "title_problem"),
    "string_data_types": (STRING_TYPES, "code_problem"),
    "column_nullability": (NULLABILITY, "code_problem"),
    "relative_notebook_references": (REFERENCES, "code_problem"),
    "avoid_select_star": (SELECT_STAR, "code_problem"),
    "partitioning_and_clustering": (PARTITIONING, "code_problem"),
    "python_vectorization": (VECTORIZATION, "code_problem"),
    "cache_usage": (CACHE, "code_problem"),
    "views_explicit_columns": (VIEWS, "code_problem"),
    "no_hard_coded_secrets": (SECRETS, "code_problem"),
    "access_controls": (ACCESS, "code_problem"),
    "unity_catalog_usage": (METASTORE, "code_problem"),
    "documentation_and_comments": (COMMENTS, "code_problem"),
    "version_control_integration": (VERSION_CONTROL, "code_problem"),
    "data_isolation": (ISOLATION, "code_problem"),
    "metadata_tagging": (TAGGING, "code_problem"),
}


def rule_sql(rule_key: str, sql: str | None = None) -> str:
    """Findings of one rule, where nothing it reads is malformed."""
    text_, problem = RULE_SQL[rule_key]
    fine = "readable" + (f" AND {problem} IS NULL" if problem else "")
    return f"{WITH} SELECT path AS notebook_path, rule, status, details, seq FROM ({sql or text_}) WHERE {fine}"


def domain_errors(domain: str) -> str:
    reason = "coalesce(head_problem, title_problem, code_problem)" if domain == f.CODE_QUALITY else "code_problem"
    name = f.DOMAIN_NAMES[domain]
    return (
        f"SELECT path, {lit(domain)} AS domain, 'domain_error' AS rule_key, {lit(name + ' Error')} AS rule, 'error' AS severity, "
        f"'Failed' AS status, {lit(f.DOMAIN_ERROR_PREFIX)} || {reason} AS details, 0::INT AS seq FROM nb WHERE readable AND {reason} IS NOT NULL"
    )


ACCESS_ROWS = (
    f"SELECT path, NULL AS domain, 'notebook_access' AS rule_key, {lit(f.ACCESS_LABEL)} AS rule, 'error' AS severity, 'Failed' AS status, "
    f"{lit(f.ACCESS_PREFIX)} || path || ': ' || {lit(f.ACCESS_UNREADABLE)} || path AS details, 0::INT AS seq FROM nb WHERE NOT readable"
)
ON_BY_DEFAULT = [row for row in DEFAULT_CATALOG if row.enabled and row.rule_key in RULE_SQL]
DOMAINS = [f.CODE_QUALITY, f.PERFORMANCE, f.SECURITY, f.GOVERNANCE]


def findings_sql(settings=tuple(ON_BY_DEFAULT), domains=tuple(DOMAINS), overrides: dict[str, str] | None = None) -> str:
    """All findings: rules of intact domains, domain errors, unreadable notebooks."""
    parts = [ACCESS_ROWS]
    for row in settings:
        sql = (overrides or {}).get(row.rule_key, RULE_SQL[row.rule_key][0])
        problems = ["code_problem"] + (["title_problem", "head_problem"] if row.domain == f.CODE_QUALITY else [])
        fine = " AND ".join(["readable"] + [f"{p} IS NULL" for p in problems])
        parts.append(
            f"SELECT path, {lit(row.domain)} AS domain, {lit(row.rule_key)} AS rule_key, rule, {lit(row.severity)} AS severity, "
            f"status, details, seq FROM ({sql}) WHERE {fine}"
        )
    parts += [domain_errors(domain) for domain in domains]
    return "(" + " UNION ALL ".join(f"({part})" for part in parts) + ")"


def masked(details: str = "details", shown: int = 0) -> str:
    prefix = lit(f.SECRET_FOUND)
    if shown:
        return f"CASE WHEN starts_with({details}, {prefix}) THEN {details}[:length({prefix}) + {shown}] || '***' ELSE {details} END"
    return f"CASE WHEN starts_with({details}, {prefix}) THEN {prefix} || '***' ELSE {details} END"


def audit_id(
    run_id: str = "", path: str = "path", copy: str = "'1'", domain: str = "domain", key: str = "rule_key", rule: str = "rule", seq: str = "seq"
) -> str:
    texts = [lit(run_id), *[f"coalesce({text}, '')" for text in (path, domain, key, rule)]]
    parts = ", ".join(f"length({text})::VARCHAR, {text}" for text in texts)
    return f"sha256(concat_ws('|', {parts}, {copy}, {seq}::VARCHAR))"


def all_findings_sql(run_id: str = "", **kwargs) -> str:
    return (
        f"{WITH}, found AS {findings_sql(**kwargs)} SELECT rule, status, details, path AS notebook_path, {audit_id(run_id)} AS audit_id, "
        "domain, rule_key, severity, seq FROM found"
    )
