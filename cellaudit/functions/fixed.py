"""The texts, patterns and word lists the results are defined by.

Nothing here is logic.  Labels, result texts, patterns, prompts and indicator
words must keep exactly these values, because findings and model requests are
compared text for text.  Patterns are written in plain regex notation and are
always applied case-insensitively unless a comment says otherwise;
``functions.text`` turns them into a form that means the same in Java and RE2.
"""

# ---- statuses ------------------------------------------------------------
PASSED = "Passed"
FAILED = "Failed"
PENDING = "Pending"
STATUSES = [PASSED, FAILED, PENDING]

SEVERITIES = ["error", "warning", "info"]

# ---- domains, in evaluation order ----------------------------------------
CODE_QUALITY = "code_quality_validation"
PERFORMANCE = "performance_validation"
SECURITY = "security_validation"
GOVERNANCE = "governance_validation"
CUSTOM = "custom_validation"

DOMAIN_NAMES = {
    CODE_QUALITY: "Code Quality Validator",
    PERFORMANCE: "Performance Validator",
    SECURITY: "Security Validator",
    GOVERNANCE: "Governance Validator",
    CUSTOM: "Custom Validator",
}

# ---- rows that replace rule findings -------------------------------------
ACCESS_LABEL = "Notebook Access"
ACCESS_PREFIX = "Failed to process notebook "
ACCESS_UNREADABLE = "Failed to create metadata from content for "
ACCESS_MISSING = "Failed to fetch notebook "
DOMAIN_ERROR_PREFIX = "Error running validator: "
NULL_SOURCE = "can only join an iterable"
NULL_TITLE = "'NoneType' object has no attribute 'strip'"

# ---- labels ---------------------------------------------------------------
LABEL_LANGUAGES = "Valid Languages"
LABEL_HEADER = "Header Section"
LABEL_TITLE = "Command Cell Title"
LABEL_TITLE_VERDICT = "Command Cell Title Descriptive"
LABEL_STRING_TYPES = "Character Columns as STRING"
LABEL_NULLABILITY = "Columns NOT NULL"
LABEL_IDEMPOTENCY = "Notebook Idempotency"
LABEL_REFERENCES = "Relative Notebook References"
LABEL_SELECT_STAR = "Avoid SELECT *"
LABEL_PARTITIONING = "Partitioning and Clustering"
LABEL_JOINS = "Efficient Joins"
LABEL_VECTORIZATION = "Python Vectorization"
LABEL_CACHE = "Cache Usage"
LABEL_VIEWS = "Views Explicit Columns"
LABEL_SECRETS = "No Hard-Coded Secrets"
LABEL_ACCESS_CONTROLS = "Access Controls"
LABEL_INJECTION = "SQL Injection Risks"
LABEL_CATALOG = "Unity Catalog Usage"
LABEL_COMMENTS = "Documentation and Comments"
LABEL_VERSION_CONTROL = "Version Control Integration"
LABEL_ISOLATION = "Data Isolation"
LABEL_TAGGING = "Metadata Tagging"

# Order in which findings of a notebook are listed.
LABEL_ORDER = [
    ACCESS_LABEL,
    "Code Quality Validator Error",
    LABEL_LANGUAGES,
    LABEL_HEADER,
    LABEL_TITLE,
    LABEL_TITLE_VERDICT,
    LABEL_STRING_TYPES,
    LABEL_NULLABILITY,
    LABEL_IDEMPOTENCY,
    LABEL_REFERENCES,
    "Performance Validator Error",
    LABEL_SELECT_STAR,
    LABEL_PARTITIONING,
    LABEL_JOINS,
    LABEL_VECTORIZATION,
    LABEL_CACHE,
    LABEL_VIEWS,
    "Security Validator Error",
    LABEL_SECRETS,
    LABEL_ACCESS_CONTROLS,
    LABEL_INJECTION,
    "Governance Validator Error",
    LABEL_CATALOG,
    LABEL_COMMENTS,
    LABEL_VERSION_CONTROL,
    LABEL_ISOLATION,
    LABEL_TAGGING,
]

# ---- result texts ---------------------------------------------------------
LANGUAGE_OK = "Notebook uses valid language: "
LANGUAGE_BAD = ("Notebook language '", "' is not in valid languages: ")
HEADER_OK = "Header section found in notebook"
HEADER_BAD = "No header section detected in first 2 cells"
TITLE_MISSING = "Command cell missing title"
TITLE_VERDICT = ("Title '", "': ")
STRING_TYPES_OK = "No VARCHAR/CHAR columns found"
STRING_TYPES_BAD = ("Found ", " VARCHAR/CHAR columns; use STRING instead")
NULLABILITY_OK = ("Column '", "' has appropriate nullability")
NULLABILITY_BAD = ("Column '", "' is nullable but not confirmed optional")
REFERENCE_OK = ("Relative path '", "' used correctly")
REFERENCE_BAD = ("Absolute path '", "' used; use relative references")
SELECT_STAR_OK = "No SELECT * found in queries"
SELECT_STAR_BAD = "SELECT * detected; specify explicit columns to reduce data scanning"
PARTITIONING_OK = "Partitioning or clustering found in table definitions"
PARTITIONING_BAD = "No partitioning or clustering found; use for performance on large tables"
VECTORIZATION_OK = "No loops with iterrows() found; vectorized operations likely used"
VECTORIZATION_BAD = "Loop with iterrows() detected; use vectorized operations or Spark APIs"
CACHE_OK = "Caching found for DataFrames or tables"
CACHE_BAD = "No caching detected; consider for reused DataFrames"
VIEW_OK = "View uses explicit column names"
VIEW_BAD = "SELECT * used in view definition; specify column names"
SECRET_FOUND = "Potential hard-coded secret found: "
SECRET_UNCLEAR = "Potential secrets detected; use dbutils.secrets.get()"
SECRET_ERROR = "No hard-coded secrets detected"
ACCESS_OK = "Access controls (GRANT/REVOKE) found"
ACCESS_BAD = "No explicit access controls found; use GRANT/REVOKE or Unity Catalog"
CATALOG_OK = "Unity Catalog usage validated"
CATALOG_BAD = "Disallowed metastore (hive_metastore or dbfs) found; use Unity Catalog"
COMMENTS_NONE = "No code to validate"
COMMENTS_OK = ("Sufficient comments found (", " of lines)")
COMMENTS_BAD = ("Insufficient comments (", " of lines, minimum ", " required)")
VERSION_CONTROL_OK = "Version control integration (repos) found"
# One word differs from the usual text on purpose: no vendor is named here.
VERSION_CONTROL_BAD = "No version control integration detected; use workspace Repos"
ISOLATION_OK = "Data paths are isolated by environment"
ISOLATION_BAD = "Mixed or non-isolated data paths detected; use dev/, staging/, or prod/ prefixes"
TAGS_OK = ("Table '", "' has all required metadata tags")
TAGS_BAD = ("Table '", "' missing required metadata tags: ")
TAG_COMMENT_OK = "Metadata information found in comments"
TAG_COMMENT_BAD = "No metadata tags or ownership information found; add TBLPROPERTIES or comments"

# ---- patterns (all ignore case) -------------------------------------------
CHARACTER_TYPE = r"(varchar|char)\s*\(\d+\)"
CREATE_TABLE = r"CREATE TABLE"
TABLE_BODY = r"CREATE TABLE.*?\((.*?)\)"  # dot also matches newlines
TABLE_COLUMN = r"(\w+)\s+(STRING|INT|TIMESTAMP|DATE|BIGINT|DECIMAL|BOOLEAN)\s*(NOT NULL)?"
NOTEBOOK_RUN = r"""dbutils\.notebook\.run\s*\(\s*['"]([^'"]+)['"]"""
SELECT_STAR = r"SELECT\s+\*"
PARTITIONED_OR_CLUSTERED = r"PARTITIONED BY|CLUSTERED BY"
ITERROWS_LOOP = r"for.*iterrows\(\)"
CACHING = r"\.cache\(\)|CACHE TABLE"
VIEW_BODY = r"CREATE\s+(?:TEMPORARY\s+)?VIEW\s+\w+.*?AS\s+(SELECT.*?)(?:;|\s*$)"  # dot also matches newlines
SECRETS = [r"Bearer\s+\w+", r"dapi\w+", r"""password\s*=\s*['"][^'"]+['"]"""]
GRANTS = r"GRANT|REVOKE|USE CATALOG"
OLD_METASTORE = r"\b(hive_metastore|dbfs)\b"
REPO_RUN = r"%run.*repos|dbutils\.notebook\.run.*repos"
ENVIRONMENT_PATH = r"dev/|staging/|prod/"
MIXED_ENVIRONMENTS = r"(dev/.*staging|staging/.*prod|dev/.*prod)"
TABLE_NAME = r"CREATE TABLE\s+(?:[a-z0-9_]+\.)?([a-z0-9_]+)"
TABLE_PROPERTY = ("TBLPROPERTIES.*['\"]?", "['\"]?\\s*=")  # tag goes between; dot also matches newlines
OWNER_COMMENT = r"#.*(?:owner|classification|purpose|business owner)"
COMMENT_STARTS = ["#", "//", "/*", '"""']
VERDICT = r"(True|False)\s*\((.*)\)"  # case matters

# ---- prompts ----------------------------------------------------------------
PROMPT_NAME = (
    "Is the following name descriptive and meaningful for a data platform "
    "activity, command, or notebook? Provide a boolean (True/False) and a "
    "brief explanation."
)
PROMPT_TITLES = (
    "For each title below, tell me if it is descriptive (True/False) "
    "and provide a brief explanation.\n\n"
)
PROMPT_BLANK_SPACE = (
    "Does the following code contain unnecessary blank lines or excessive "
    "whitespace? Return 'True' if it does, 'False' otherwise, with a brief "
    "explanation."
)
PROMPT_RESTARTABLE = (
    "Is the following notebook code restartable (e.g., handles state "
    "appropriately, avoids hard-coded paths)? Return 'True' if restartable, "
    "'False' otherwise, with a brief explanation."
)
PROMPT_JOINS = (
    "Analyze the following SQL code for join efficiency issues such as "
    "data skew, cartesian products, or missing broadcast hints. "
    "Return 'True' if joins are efficient, 'False' if there are issues, "
    "with a detailed explanation."
)
PROMPT_INJECTION = (
    "Analyze the following code for SQL injection vulnerabilities. "
    "Look for dynamic SQL construction using string interpolation, "
    "format strings, or concatenation. Return 'True' if the code is "
    "secure from SQL injection, 'False' if vulnerabilities exist, "
    "with a detailed explanation and suggestions."
)
# Used only where the catalog gives no ``llm_prompt``.
PROMPT_SECRETS = (
    "Scan for potential hard-coded secrets in this code. Return 'True' if "
    "secure, 'False' if secrets found, with explanation."
)
PROMPT_PARTITIONING = (
    "Suggest optimal partitioning/clustering columns based on schema. Return "
    "'True' if optimized, 'False' if not, with explanation."
)
PROMPT_CACHE = (
    "Check if this code could benefit from caching. Return 'True' if caching "
    "is appropriate, 'False' if not needed, with explanation."
)

# ---- verdict texts ------------------------------------------------------------
VERDICT_ERROR = "LLM error: "
VERDICT_PARSE_ERROR = "LLM parsing error"
NAME_ERROR = "LLM failed to evaluate name."
UNANSWERED = "Awaiting model verdict"  # ours: no answer stored yet
TITLE_BATCH = 5

# Answer is "secure" if one row of SECURE matches and no row of VULNERABLE does.
# A row matches if the lower-cased answer has every word of its first list and,
# where a second list is given, at least one word of that.
SECURE = [
    (["true", "secure"], []),
    (["sql injection analysis: true"], []),
    (["secure from sql injection"], []),
    (["no sql injection", "secure"], []),
    (["safe"], ["sql", "injection"]),
]
VULNERABLE = [
    (["false"], ["sql injection", "vulnerable"]),
    (["sql injection risk", "found"], []),
    (["vulnerable to sql injection"], []),
]

# ---- other ----------------------------------------------------------------------
WORKSPACE_PREFIX = "/Workspace/"
TICKET_TITLE = "Code Standard Violation: "
