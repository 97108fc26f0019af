"""Building notebooks for tests."""

import json

from cellaudit.operators import engine
from cellaudit.operators.catalog import DEFAULT_CATALOG, enable_rules

CORPUS = "path string, content string"


def code_cell(*lines, **extra):
    return {"cell_type": "code", "source": list(lines), **extra}


def notebook(*cells, language="python"):
    return json.dumps({"metadata": {"kernelspec": {"language": language}}, "cells": list(cells)})


def corpus(spark, contents):
    """One notebook per content, at paths 0, 1, 2, ..."""
    return spark.createDataFrame([(str(i), content) for i, content in enumerate(contents)], CORPUS)


def findings(spark, rule_key, contents, **parameters):
    """Rows ``(status, details)`` of one rule for every notebook, in order."""
    catalog = enable_rules(DEFAULT_CATALOG, only=[rule_key], parameters={rule_key: parameters})
    rows = engine.validate(corpus(spark, contents), catalog).filter(f"rule_key = '{rule_key}'").collect()
    found = [[] for _ in contents]
    for row in sorted(rows, key=lambda r: r["seq"]):
        found[int(row["notebook_path"])].append((row["status"], row["details"]))
    return found


def code_findings(spark, rule_key, codes, **parameters):
    return findings(spark, rule_key, [notebook(code_cell(code)) for code in codes], **parameters)


def statuses(spark, rule_key, codes, **parameters):
    return ["".join(s[0] for s, _ in rows) for rows in code_findings(spark, rule_key, codes, **parameters)]
