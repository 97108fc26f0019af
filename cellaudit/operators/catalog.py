"""The rule catalog: which rules run, with what severity and parameters.

A catalog is a small table of settings, one row per rule.  Evaluation is built
from its rows, so a rule that is off never enters the plan.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

SCHEMA = (
    "domain: string, rule_key: string, label: string, enabled: boolean, severity: string, "
    "type: string, description: string, parameters: map<string,string>"
)
SCHEMA_NAMES = ["domain", "rule_key", "label", "enabled", "severity", "type", "description", "parameters"]


@dataclass(frozen=True)
class Setting:
    """One row of the catalog."""

    domain: str
    rule_key: str
    label: str
    severity: str = "error"
    enabled: bool = True
    type: str = "regex"
    description: str = ""
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.severity not in fixed.SEVERITIES:
            raise ValueError(f"severity {self.severity!r} is none of {fixed.SEVERITIES}")


# Severities, switches and parameters the rules start from.
DEFAULT_CATALOG = [
    Setting(fixed.CODE_QUALITY, "valid_languages_only", fixed.LABEL_LANGUAGES, "error",
            parameters={"allowed_languages": ["sql", "python", "scala", "r"]}),
    Setting(fixed.CODE_QUALITY, "header_section_exists", fixed.LABEL_HEADER, "warning"),
    Setting(fixed.CODE_QUALITY, "descriptive_cell_titles", fixed.LABEL_TITLE, "warning"),
    Setting(fixed.CODE_QUALITY, "string_data_types", fixed.LABEL_STRING_TYPES, "error"),
    Setting(fixed.CODE_QUALITY, "column_nullability", fixed.LABEL_NULLABILITY, "warning"),
    Setting(fixed.CODE_QUALITY, "notebook_idempotency", fixed.LABEL_IDEMPOTENCY, "warning"),
    Setting(fixed.CODE_QUALITY, "relative_notebook_references", fixed.LABEL_REFERENCES, "error"),
    Setting(fixed.PERFORMANCE, "avoid_select_star", fixed.LABEL_SELECT_STAR, "error"),
    Setting(fixed.PERFORMANCE, "partitioning_and_clustering", fixed.LABEL_PARTITIONING, "warning",
            parameters={"llm_prompt": "Suggest optimal partitioning/clustering columns based on schema"}),
    Setting(fixed.PERFORMANCE, "efficient_joins", fixed.LABEL_JOINS, "error"),
    Setting(fixed.PERFORMANCE, "python_vectorization", fixed.LABEL_VECTORIZATION, "warning"),
    Setting(fixed.PERFORMANCE, "cache_usage", fixed.LABEL_CACHE, "warning",
            parameters={"llm_prompt": "Check if this code could benefit from caching"}),
    Setting(fixed.SECURITY, "no_hard_coded_secrets", fixed.LABEL_SECRETS, "error",
            parameters={"regex_patterns": fixed.SECRETS,
                        "llm_prompt": "Scan for potential hard-coded secrets in this code"}),
    Setting(fixed.SECURITY, "access_controls", fixed.LABEL_ACCESS_CONTROLS, "error"),
    Setting(fixed.SECURITY, "sql_injection_risks", fixed.LABEL_INJECTION, "error"),
    Setting(fixed.GOVERNANCE, "unity_catalog_usage", fixed.LABEL_CATALOG, "error"),
    Setting(fixed.GOVERNANCE, "documentation_and_comments", fixed.LABEL_COMMENTS, "warning",
            parameters={"min_comment_ratio": 0.1, "check_patterns": fixed.COMMENT_STARTS}),
    Setting(fixed.GOVERNANCE, "version_control_integration", fixed.LABEL_VERSION_CONTROL, "warning", enabled=False),
    Setting(fixed.GOVERNANCE, "data_isolation", fixed.LABEL_ISOLATION, "warning", enabled=False),
    Setting(fixed.GOVERNANCE, "metadata_tagging", fixed.LABEL_TAGGING, "warning",
            parameters={"required_tags": ["owner"]}),
    # Exists but is listed nowhere by default, hence off.
    Setting(fixed.PERFORMANCE, "views_explicit_columns", fixed.LABEL_VIEWS, "warning", enabled=False),
]


# ---- FND5 ----------------------------------------------------------------------
def enable_rules(
    catalog: Iterable[Setting],
    *,
    only: Iterable[str] | None = None,
    on: Iterable[str] = (),
    off: Iterable[str] = (),
    off_domains: Iterable[str] = (),
    parameters: dict[str, dict] | None = None,
) -> list[Setting]:
    """The catalog with rules or whole domains switched and parameters replaced."""
    only = None if only is None else set(only)
    on, off, off_domains = set(on), set(off), set(off_domains)
    changed = []
    for row in catalog:
        enabled = row.rule_key in only if only is not None else (row.enabled or row.rule_key in on)
        enabled = enabled and row.rule_key not in off and row.domain not in off_domains
        extra = (parameters or {}).get(row.rule_key, {})
        changed.append(replace(row, enabled=enabled, parameters={**row.parameters, **extra}))
    return changed


def rule_catalog(spark: SparkSession, catalog: Iterable[Setting] = tuple(DEFAULT_CATALOG)) -> DataFrame:
    """The catalog as a table; list and number parameters are kept as JSON.

    It is a constant of the plan, so Spark knows how small it is when joining it.
    """
    rows = [_as_row(asdict(row)) for row in catalog]
    constant = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{SCHEMA}>>")
    return spark.range(1).select(F.inline(constant))


def _as_row(row: dict) -> dict:
    return {**row, "parameters": {name: json.dumps(value) for name, value in row["parameters"].items()}}


def read_catalog(table: DataFrame) -> list[Setting]:
    """Settings from a catalog table.  Settings shape the plan, so the driver needs them."""
    rows = table.select(*SCHEMA_NAMES).collect()
    return [
        Setting(**{**row.asDict(), "parameters": {k: json.loads(v) for k, v in (row["parameters"] or {}).items()}})
        for row in rows
    ]


def rules_version(catalog: Iterable[Setting], extra: Iterable = ()) -> str:
    """A hash that changes whenever an enabled rule or one of its parameters does.

    The order of rows and their descriptions don't matter.  ``extra``: rules of
    one's own, known by domain, key and label; a new label marks a new version.
    """
    rows = [{k: v for k, v in asdict(row).items() if k != "description"} for row in catalog if row.enabled]
    own = [{"domain": rule.domain, "rule_key": rule.rule_key, "label": rule.label, "own": True} for rule in extra]
    active = sorted(rows + own, key=lambda row: json.dumps(row, sort_keys=True))
    return hashlib.sha256(json.dumps(active, sort_keys=True).encode()).hexdigest()


# ---- FND8 ----------------------------------------------------------------------
def attach_severity(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Severity and domain: the finding's own, else those of the catalog.

    Findings that no rule made (unreadable notebooks, errors of a domain) are in no
    catalog and keep what they say.  No broadcast is forced: the catalog is small
    and Spark sees its size.
    """
    names = ["severity", "domain"]
    known = catalog.select("rule_key", *[F.col(name).alias(f"listed_{name}") for name in names])
    own = {name: F.col(name) if name in findings.columns else F.lit(None).cast("string") for name in names}
    joined = findings.join(known, "rule_key", "left")
    filled = joined.withColumns({name: F.coalesce(own[name], F.col(f"listed_{name}")) for name in names})
    return filled.drop(*[f"listed_{name}" for name in names])
