"""Queries on model verdicts, over stored responses derived from the requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellaudit.functions import fixed, shared, text
from cellaudit.operators import audit, engine, verdicts
from cellaudit.operators.catalog import DEFAULT_CATALOG
from cellaudit.operators.responses import ResponseStore

from . import oracle as o
from .fixture import corpus, documents, notebooks_from, table
from .registry import query

# The answer to a question is chosen by the first hex digit of its id.
ANSWERS = [
    "True (ok (fine))", "Verdict: False (bad)", "true (x)", "no", "False\n(multi)", "True, the code is secure",
    "Vulnerable to SQL injection: False", None, None, " True () ", "safe from sql", "sql injection risk found; False (risk)",
    "No SQL injection here, secure", "TRUE secure", "True(fast)", "SQL injection analysis: TRUE",
]
ERROR_DIGIT, UNANSWERED_DIGIT = "7", "8"
HEX = "0123456789abcdef"


def _digit() -> Column:
    return F.substring("request_id", 1, 1)


def responses(requests: DataFrame) -> DataFrame:
    """Stored answers: some are errors, some questions have none."""
    answer = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), F.instr(F.lit(HEX), _digit()))
    error = F.when(_digit() == ERROR_DIGIT, "timeout")
    answered = requests.filter(_digit() != UNANSWERED_DIGIT)
    return answered.select("request_id", answer.alias("content"), error.alias("error"))


def sql_answers(source: str) -> str:
    values = ", ".join("NULL" if a is None else o.lit(a) for a in ANSWERS)
    return (
        f"SELECT *, CASE WHEN request_id[1] <> '{UNANSWERED_DIGIT}' THEN [{values}][instr('{HEX}', request_id[1])] END AS content, "
        f"CASE WHEN request_id[1] = '{ERROR_DIGIT}' THEN 'timeout' END AS error FROM {source}"
    )


SETTINGS = {row.rule_key: row for row in DEFAULT_CATALOG}
UNDECIDED = {
    "notebook_idempotency": "title_problem IS NULL",
    "partitioning_and_clustering": f"NOT {o.has(fixed.PARTITIONED_OR_CLUSTERED)}",
    "efficient_joins": "TRUE",
    "cache_usage": f"NOT {o.has(fixed.CACHING)}",
    "no_hard_coded_secrets": " AND ".join(f"NOT {o.has(p)}" for p in fixed.SECRETS),
    "sql_injection_risks": "TRUE",
}
PROMPTS = {
    "notebook_idempotency": fixed.PROMPT_RESTARTABLE,
    "partitioning_and_clustering": SETTINGS["partitioning_and_clustering"].parameters["llm_prompt"],
    "efficient_joins": fixed.PROMPT_JOINS,
    "cache_usage": SETTINGS["cache_usage"].parameters["llm_prompt"],
    "no_hard_coded_secrets": SETTINGS["no_hard_coded_secrets"].parameters["llm_prompt"],
    "sql_injection_risks": fixed.PROMPT_INJECTION,
}
ASKS = " UNION ALL ".join(
    f"SELECT path, code, {o.lit(key)} AS rule_key, {o.lit(PROMPTS[key])} AS system FROM nb "
    f"WHERE readable AND code_problem IS NULL AND {UNDECIDED[key]}"
    for key in PROMPTS
)
LINKS = f"links AS (SELECT *, sha256(system || chr(10) || sha256(code)) AS request_id FROM ({ASKS}))"
ANSWERED = f"{o.WITH}, {LINKS}, answered AS ({sql_answers('links')})"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.request_links(corpus(spark, sf_dir))


def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(verdicts.build_requests(corpus(spark, sf_dir)))


# ---- MDL1 ----------------------------------------------------------------------------
@query(
    "mdl1_build_requests",
    f"{o.WITH}, {LINKS} SELECT DISTINCT request_id, system, sha256(code) AS user_sha, length(code)::INT AS user_chars FROM links",
)
def mdl1(spark, sf_dir):
    asked = verdicts.build_requests(corpus(spark, sf_dir))
    return asked.select("request_id", "system", F.sha2("user", 256).alias("user_sha"), F.length("user").alias("user_chars"))


@query("mdl1_request_links", f"{o.WITH}, {LINKS} SELECT path, rule_key, request_id FROM links")
def mdl1_links(spark, sf_dir):
    return links(spark, sf_dir).select("path", "rule_key", "request_id")


# ---- MDL4, MDL5, MDL6 ----------------------------------------------------------------
PENDING = f"WHEN content IS NULL THEN {o.lit(fixed.PENDING)}"
PENDING_TEXT = f"WHEN content IS NULL THEN {o.lit(fixed.UNANSWERED)}"
ERROR_TEXT = f"{o.lit(fixed.VERDICT_ERROR)} || error"


def sql_true(positive: str = "contains(content, 'True')") -> tuple[str, str]:
    return (
        f"CASE WHEN error IS NOT NULL THEN 'Failed' {PENDING} WHEN {positive} THEN 'Passed' ELSE 'Failed' END",
        f"CASE WHEN error IS NOT NULL THEN {ERROR_TEXT} {PENDING_TEXT} ELSE content END",
    )


def sql_pattern(no_match: str, on_error: str) -> tuple[str, str]:
    stripped = f"trim(content, {o.lit(text.BLANKS)})"
    pattern = o.re2(fixed.VERDICT)
    hit = f"regexp_matches({stripped}, {pattern})"
    return (
        f"CASE WHEN error IS NOT NULL THEN 'Failed' {PENDING} WHEN {hit} AND regexp_extract({stripped}, {pattern}, 1) = 'True' THEN 'Passed' ELSE 'Failed' END",
        f"CASE WHEN error IS NOT NULL THEN {o.lit(on_error)} {PENDING_TEXT} WHEN {hit} THEN regexp_extract({stripped}, {pattern}, 2) ELSE {o.lit(no_match)} END",
    )


def _c(word: str) -> str:
    return f"contains(lower(content), {o.lit(word)})"


SECURE = (
    f"(({_c('true')} AND {_c('secure')}) OR {_c('sql injection analysis: true')} OR {_c('secure from sql injection')} "
    f"OR ({_c('no sql injection')} AND {_c('secure')}) OR ({_c('safe')} AND ({_c('sql')} OR {_c('injection')})))"
)
VULNERABLE = (
    f"(({_c('false')} AND ({_c('sql injection')} OR {_c('vulnerable')})) OR ({_c('sql injection risk')} AND {_c('found')}) "
    f"OR {_c('vulnerable to sql injection')})"
)
READ = {
    "notebook_idempotency": sql_true(),
    "partitioning_and_clustering": sql_pattern(fixed.PARTITIONING_BAD, fixed.PARTITIONING_BAD),
    "efficient_joins": sql_true(),
    "cache_usage": sql_pattern(fixed.CACHE_BAD, fixed.CACHE_BAD),
    "no_hard_coded_secrets": sql_pattern(fixed.SECRET_UNCLEAR, fixed.SECRET_ERROR),
    "sql_injection_risks": sql_true(f"({SECURE} AND NOT {VULNERABLE})"),
}


def _read_all(reading: tuple[str, str]) -> str:
    return f"{ANSWERED} SELECT path, rule_key, {reading[0]} AS status, {reading[1]} AS details FROM answered"


def read_all(spark, sf_dir, reader: Column) -> DataFrame:
    """Every answer read in one way, whatever rule asked."""
    joined = links(spark, sf_dir).join(stored_responses(spark, sf_dir), "request_id", "left")
    return joined.select("path", "rule_key", reader.alias("row")).select("path", "rule_key", "row.status", "row.details")


@query("mdl4_verdict_contains_true", _read_all(sql_true()))
def mdl4(spark, sf_dir):
    return read_all(spark, sf_dir, verdicts.verdict_contains_true())


@query("mdl5_verdict_pattern", _read_all(sql_pattern("unclear", "failed")))
def mdl5(spark, sf_dir):
    return read_all(spark, sf_dir, verdicts.verdict_pattern("unclear", "failed"))


@query("mdl6_verdict_injection", _read_all(READ["sql_injection_risks"]))
def mdl6(spark, sf_dir):
    return read_all(spark, sf_dir, verdicts.verdict_injection())


# ---- MDL8 and the rules it decides ---------------------------------------------------
LABELS = {rule.rule_key: rule for rule in verdicts.VERDICT_RULES}


def verdict_rows_sql(key: str) -> str:
    rule = LABELS[key]
    return (
        f"SELECT path, {o.lit(rule.label)} AS rule, {READ[key][0]} AS status, {READ[key][1]} AS details, 0::INT AS seq, "
        f"{o.lit(rule.domain)} AS domain, rule_key, {o.lit(SETTINGS[key].severity)} AS severity FROM answered WHERE rule_key = {o.lit(key)}"
    )


VERDICT_ROWS = " UNION ALL ".join(verdict_rows_sql(key) for key in PROMPTS)
SHOWN = "rule, status, details, path AS notebook_path, domain, rule_key, severity, seq"


@query("mdl8_join_verdicts", f"{ANSWERED}, rows AS ({VERDICT_ROWS}) SELECT {SHOWN}, {o.audit_id()} AS audit_id FROM rows")
def mdl8(spark, sf_dir):
    found = verdicts.join_verdicts(links(spark, sf_dir), stored_responses(spark, sf_dir))
    return found.select("rule", "status", "details", "notebook_path", "domain", "rule_key", "severity", "seq", "audit_id")


def rule_verdicts(spark, sf_dir, key: str) -> DataFrame:
    catalog = [row for row in DEFAULT_CATALOG if row.rule_key in (key, "descriptive_cell_titles")]
    books = corpus(spark, sf_dir)
    found = verdicts.join_verdicts(verdicts.request_links(books, catalog), responses(verdicts.build_requests(books, catalog)), catalog)
    return found.select("notebook_path", "rule", "status", "details")


for _name, _key in {
    "r06_notebook_idempotency": "notebook_idempotency",
    "r09_partitioning_verdict": "partitioning_and_clustering",
    "r10_efficient_joins": "efficient_joins",
    "r12_cache_verdict": "cache_usage",
    "r14_secrets_verdict": "no_hard_coded_secrets",
    "r16_sql_injection_risks": "sql_injection_risks",
}.items():
    query(_name, f"{ANSWERED}, rows AS ({verdict_rows_sql(_key)}) SELECT path AS notebook_path, rule, status, details FROM rows")(
        lambda spark, sf_dir, key=_key: rule_verdicts(spark, sf_dir, key)
    )


# ---- titles: MDL2, MDL3, R03b --------------------------------------------------------
def line_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks of many cells: every line of a document is a code cell titled by its first word."""

    def cell(line: Column) -> Column:
        return F.to_json(F.struct(F.lit("code").alias("cell_type"), F.split(line, " ")[0].alias("title"), F.array(line).alias("source")))

    cells = F.array_join(F.transform(F.split("text", "\n"), cell), ",")
    content = F.concat(F.lit('{"cells":['), cells, F.lit("]}"))
    return documents(spark, sf_dir).select(F.concat(F.lit("/Lines/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"))


def title_responses(title_links: DataFrame) -> DataFrame:
    """Answers per batch: proper, untidy, too short, too long, in error or none."""
    n, kind = F.size("titles"), (F.instr(F.lit(HEX), _digit()) - 1) % 8

    def numbered(count: Column, before: str, after: str) -> Column:
        made = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit(before), i.cast("string"), F.lit(after)))
        return F.when(count > 0, F.array_join(made, "\n")).otherwise(F.lit(""))

    content = (
        F.when(kind == 0, numbered(n, "", ". True (good)"))
        .when(kind == 1, numbered(n, "", ". False (bad name)"))
        .when(kind == 2, numbered(n, "\r\n  ", ".  True (two blanks) \t"))
        .when(kind == 3, F.lit("yes"))
        .when(kind == 4, numbered(n - 1, "", ". TRUE"))
        .when(kind == 7, numbered(n + 2, "", ". true (too many)"))
    )
    asked = title_links.select("request_id", "titles").dropDuplicates(["request_id"]).filter(kind != 6)
    return asked.select("request_id", content.alias("content"), F.when(kind == 5, "timeout").alias("error"))


TITLES = f"""lines AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
titled AS (SELECT d, title, row_number() OVER (PARTITION BY d ORDER BY pos) - 1 AS idx
  FROM (SELECT d, pos, trim(string_split(line, ' ')[1], {o.lit(text.BLANKS)}) AS title FROM lines) WHERE title <> ''),
batches AS (SELECT d, idx // 5 AS batch, count(*) AS n,
    {o.lit(fixed.PROMPT_TITLES)} || string_agg((idx % 5 + 1) || '. ' || title || chr(10), '' ORDER BY idx) AS system
  FROM titled GROUP BY d, idx // 5),
asked AS (SELECT *, sha256(system || chr(10) || sha256('')) AS request_id FROM batches),
kinds AS (SELECT *, (instr('{HEX}', request_id[1]) - 1) % 8 AS kind FROM asked)"""


def _sql_numbered(count: str, before: str, after: str) -> str:
    return f"array_to_string(list_transform(range(1, ({count}) + 1), lambda i: {before} || i || {after}), chr(10))"


LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
TITLE_VERDICTS = f"""{TITLES},
contents AS (SELECT *, CASE kind
    WHEN 0 THEN {_sql_numbered('n', "''", "'. True (good)'")} WHEN 1 THEN {_sql_numbered('n', "''", "'. False (bad name)'")}
    WHEN 2 THEN {_sql_numbered('n', "chr(13) || chr(10) || '  '", "'.  True (two blanks) ' || chr(9)")} WHEN 3 THEN 'yes'
    WHEN 4 THEN {_sql_numbered('n - 1', "''", "'. TRUE'")} WHEN 7 THEN {_sql_numbered('n + 2', "''", "'. true (too many)'")} END AS content
  FROM kinds),
pieces AS (
  SELECT d, batch, p, trim(piece, {o.lit(text.BLANKS)}) AS line FROM (
    SELECT d, batch, unnest(regexp_split_to_array(content, '{LINE_ENDS}')) AS piece,
      generate_subscripts(regexp_split_to_array(content, '{LINE_ENDS}'), 1) AS p FROM contents WHERE content IS NOT NULL)),
words AS (SELECT d, batch, p, line, instr(line, ' ') AS s, substr(line, instr(line, ' ') + 1) AS rest FROM pieces WHERE line <> ''),
verdicts AS (
  SELECT d, batch, p, CASE WHEN s > 0 AND contains(lower(CASE WHEN instr(rest, ' ') > 0 THEN substr(rest, 1, instr(rest, ' ') - 1) ELSE rest END), 'true') THEN 'Passed' ELSE 'Failed' END AS status,
    CASE WHEN s = 0 THEN {o.lit(fixed.VERDICT_PARSE_ERROR)} WHEN instr(rest, ' ') > 0 THEN substr(rest, instr(rest, ' ') + 1) ELSE '' END AS explanation FROM words
  UNION ALL SELECT d, batch, unnest(range(n)), 'Failed', {o.lit(fixed.VERDICT_ERROR + 'timeout')} FROM kinds WHERE kind = 5
  UNION ALL SELECT d, batch, unnest(range(n)), 'Pending', {o.lit(fixed.UNANSWERED)} FROM kinds WHERE kind = 6),
placed AS (SELECT d, status, explanation, row_number() OVER (PARTITION BY d ORDER BY batch, p) - 1 AS idx FROM verdicts),
matched AS (SELECT '/Lines/' || d AS path, idx::INT AS seq, title, status, {o.lit(fixed.TITLE_VERDICT[0])} || title || {o.lit(fixed.TITLE_VERDICT[1])} || explanation AS details
  FROM placed JOIN titled USING (d, idx))"""


@query("mdl2_batch_title_prompts", f"WITH {TITLES} SELECT DISTINCT request_id, system, '' AS user FROM asked")
def mdl2(spark, sf_dir):
    return verdicts.batch_title_prompts(line_notebooks(spark, sf_dir))


@query("mdl3_parse_title_verdicts", f"WITH {TITLE_VERDICTS} SELECT path, seq, title, status, details FROM matched")
def mdl3(spark, sf_dir):
    asked = verdicts.title_links(line_notebooks(spark, sf_dir))
    return verdicts.title_verdicts(asked, title_responses(asked)).select("path", "seq", "title", "status", "details")


TITLE_LABEL = o.lit(fixed.LABEL_TITLE_VERDICT)


@query(
    "r03b_title_verdicts",
    f"WITH {TITLE_VERDICTS} SELECT path AS notebook_path, {TITLE_LABEL} AS rule, status, details, seq, "
    f"{o.audit_id(domain=o.lit(fixed.CODE_QUALITY), key=o.lit('descriptive_cell_titles'), rule=TITLE_LABEL)} AS audit_id, 'warning' AS severity FROM matched",
)
def r03b(spark, sf_dir):
    asked = verdicts.title_links(line_notebooks(spark, sf_dir))
    found = verdicts.title_findings(asked, title_responses(asked))
    return found.select("notebook_path", "rule", "status", "details", "seq", "audit_id", "severity")


# ---- MDL7 ----------------------------------------------------------------------------
def word_count_model(system: str, user: str) -> str:
    """Stands in for a model: repeatable, and refuses text without a line break."""
    if "\n" not in user:
        raise ValueError("one line")
    return f"True ({len(user)} characters, {user.count(chr(10))} breaks)"


@query(
    "mdl7_score_requests",
    f"""{o.WITH}, {LINKS} SELECT DISTINCT request_id,
      'True (' || length(code) || ' characters, ' || (length(code) - length(replace(code, chr(10), ''))) || ' breaks)' AS content,
      NULL::VARCHAR AS error FROM links""",
)
def mdl7(spark, sf_dir):
    return verdicts.score_requests(verdicts.build_requests(corpus(spark, sf_dir)), word_count_model, 8)


# ---- MDL9, MDL10 ---------------------------------------------------------------------
def _single(key: str, system: str, error_text: str, flag: str) -> str:
    return f"""asked AS (SELECT {key} AS shown, sha256({o.lit(system)} || chr(10) || sha256(asked_text)) AS request_id FROM things),
    answered AS ({sql_answers('asked')})
    SELECT shown AS {key}, (CASE WHEN error IS NOT NULL THEN FALSE ELSE contains(content, 'True') END)::VARCHAR AS {flag},
      CASE WHEN error IS NOT NULL THEN {error_text} ELSE content END AS explanation FROM answered"""


@query(
    "mdl9_name_descriptive",
    "WITH things AS (SELECT DISTINCT event_type || ' ' || user_id AS name, event_type || ' ' || user_id AS asked_text FROM events), "
    + _single("name", fixed.PROMPT_NAME, o.lit(fixed.NAME_ERROR), "descriptive"),
)
def mdl9(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("name"))
    asked = verdicts.single_requests(names.distinct(), fixed.PROMPT_NAME, "name")
    return verdicts.name_descriptive(names, responses(asked)).withColumn("descriptive", F.col("descriptive").cast("string"))


@query(
    "mdl10_blank_space",
    f"{o.WITH}, things AS (SELECT path, code AS asked_text FROM nb WHERE readable AND code_problem IS NULL), "
    + _single("path", fixed.PROMPT_BLANK_SPACE, ERROR_TEXT, "unnecessary"),
)
def mdl10(spark, sf_dir):
    from .notebook_queries import intact

    from cellaudit.operators.cells import with_code

    books = with_code(intact(spark, sf_dir)).withColumn("readable", F.lit(True))
    asked = verdicts.single_requests(books, fixed.PROMPT_BLANK_SPACE, "code")
    found = verdicts.blank_space(books, responses(asked.dropDuplicates(["request_id"])))
    return found.withColumn("unnecessary", F.col("unnecessary").cast("string"))


# ---- everything ----------------------------------------------------------------------
@query(
    "fnd2_validate_with_verdicts",
    f"""{ANSWERED}, rows AS ({VERDICT_ROWS}), found AS {o.findings_sql()}
    SELECT rule, status, details, path AS notebook_path, rule_key, seq FROM found
    UNION ALL SELECT rule, status, details, path, rule_key, seq FROM rows""",
)
def with_verdicts(spark, sf_dir):
    """Findings of the text rules and of the rules a model decides from code."""
    books = corpus(spark, sf_dir)
    decided = engine.validate(books)
    asked = verdicts.join_verdicts(verdicts.request_links(books), responses(verdicts.build_requests(books)))
    both = decided.unionByName(asked)
    return both.select("rule", "status", "details", "notebook_path", "rule_key", "seq")


# ---- all 21 rules in one pass ----------------------------------------------------------
# Every notebook of the fixture has at most one titled code cell: one batch of one title.
FIRST_LINE = (
    f"list_filter(list_transform(regexp_split_to_array(content, '{LINE_ENDS}'), lambda x: trim(x, {o.lit(text.BLANKS)})), lambda x: x <> '')[1]"
)
TITLE_LINE = f"""title_asked AS (SELECT path, title, sha256({o.lit(fixed.PROMPT_TITLES)} || '1. ' || title || chr(10) || chr(10) || sha256('')) AS request_id
  FROM nb WHERE readable AND title IS NOT NULL AND title_problem IS NULL AND head_problem IS NULL AND code_problem IS NULL),
title_answers AS ({sql_answers('title_asked')}),
title_lines AS (SELECT *, {FIRST_LINE} AS line FROM title_answers),
title_words AS (SELECT *, instr(line, ' ') AS s, substr(line, instr(line, ' ') + 1) AS rest FROM title_lines),
title_read AS (SELECT path, title, error, content, line,
    CASE WHEN error IS NOT NULL THEN 'Failed' WHEN content IS NULL THEN 'Pending'
      WHEN s > 0 AND contains(lower(CASE WHEN instr(rest, ' ') > 0 THEN substr(rest, 1, instr(rest, ' ') - 1) ELSE rest END), 'true') THEN 'Passed' ELSE 'Failed' END AS status,
    CASE WHEN error IS NOT NULL THEN {ERROR_TEXT} WHEN content IS NULL THEN {o.lit(fixed.UNANSWERED)} WHEN s = 0 THEN {o.lit(fixed.VERDICT_PARSE_ERROR)}
      WHEN instr(rest, ' ') > 0 THEN substr(rest, instr(rest, ' ') + 1) ELSE '' END AS explanation
  FROM title_words WHERE content IS NULL OR line IS NOT NULL),
title_rows AS (SELECT path, {TITLE_LABEL} AS rule, status, {o.lit(fixed.TITLE_VERDICT[0])} || title || {o.lit(fixed.TITLE_VERDICT[1])} || explanation AS details,
    0::INT AS seq, {o.lit(fixed.CODE_QUALITY)} AS domain, 'descriptive_cell_titles' AS rule_key, 'warning' AS severity FROM title_read)"""
ALL_ROWS = f"""everything AS (SELECT path, rule, status, details, seq, domain, rule_key, severity FROM found
  UNION ALL SELECT path, rule, status, details, seq, domain, rule_key, severity FROM rows
  UNION ALL SELECT path, rule, status, details, seq, domain, rule_key, severity FROM title_rows)"""
WHOLE_AUDIT = f"{ANSWERED}, rows AS ({VERDICT_ROWS}), found AS {o.findings_sql()}, {TITLE_LINE}, {ALL_ROWS}"


def all_responses(asked: DataFrame) -> DataFrame:
    """Stored answers to all questions of an audit, titles included."""
    return responses(asked.select("request_id"))


@query("fnd2_all_rules_in_one_pass", f"{WHOLE_AUDIT} SELECT {SHOWN.replace('details', o.masked() + ' AS details', 1)}, {o.audit_id()} AS audit_id FROM everything")
def all_rules(spark, sf_dir):
    """Text rules, code verdicts and title verdicts: the corpus is read and searched once."""
    whole = audit.open_audit(corpus(spark, sf_dir))
    asked = whole.links().select("request_id").unionByName(whole.title_links().select("request_id")).distinct()
    return whole.complete(all_responses(asked)).select("rule", "status", "details", "notebook_path", "domain", "rule_key", "severity", "seq", "audit_id")


@query(
    "mdl1_all_requests",
    f"""{o.WITH}, {LINKS}, {TITLE_LINE} SELECT DISTINCT request_id, sha256(system) AS system_sha, sha256(code) AS user_sha FROM links
    UNION ALL SELECT DISTINCT request_id, sha256({o.lit(fixed.PROMPT_TITLES)} || '1. ' || title || chr(10)), sha256('') FROM title_asked""",
)
def mdl1_all(spark, sf_dir):
    """Every distinct question with its text, looked up after questions were told apart."""
    asked = verdicts.all_requests(corpus(spark, sf_dir))
    return asked.select("request_id", F.sha2("system", 256).alias("system_sha"), F.sha2("user", 256).alias("user_sha"))


# ---- MDL7: a second night --------------------------------------------------------------
def digest_model(system: str, user: str) -> str:
    """Stands in for a model: its answer is made of the question's hash, one in sixteen fails."""
    import hashlib

    hashed = hashlib.sha256(user.encode()).hexdigest()
    question = hashlib.sha256(f"{system}\n{hashed}".encode()).hexdigest()
    if question[0] == "0":
        raise ValueError(f"refused {question[:6]}")
    return f"True ({question[:6]})"


@query(
    "mdl7_second_run_asks_only_new",
    f"""{o.WITH}, {LINKS}, {TITLE_LINE},
    asked AS (SELECT path, request_id FROM links UNION ALL SELECT path, request_id FROM title_asked),
    firsts AS (SELECT DISTINCT request_id FROM asked JOIN nb USING (path) JOIN documents ON doc_id = d WHERE lang IS DISTINCT FROM 'fr'),
    everything AS (SELECT DISTINCT request_id FROM asked)
    SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM firsts) THEN 'first' ELSE 'second' END AS run,
      CASE WHEN request_id[1] <> '0' THEN 'True (' || request_id[:6] || ')' END AS content,
      CASE WHEN request_id[1] = '0' THEN 'refused ' || request_id[:6] END AS error FROM everything""",
)
def mdl7_second(spark, sf_dir):
    """Two nights with one store; in the first, French documents were not there yet."""
    now = documents(spark, sf_dir)
    before = now.filter(~F.col("lang").eqNullSafe("fr"))
    store = ResponseStore(spark, shared.new_location(spark, "store"))
    audit.open_audit(notebooks_from(before), run_id="first").ask(store, digest_model, 8, per_task=64)
    audit.open_audit(notebooks_from(now), run_id="second").ask(store, digest_model, 8, per_task=64)
    # every row that was ever written: a question asked twice would be here twice
    asked_in = store.slices().select("slice", "run")
    return store.rows().join(asked_in, "slice").select("request_id", "run", "content", "error")
