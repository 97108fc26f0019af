"""The entry point with and without the operators for training data."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OPTIONAL = ("cellaudit/llm", "tests/llm", "corpus_pipeline.py")
CODE = "import __spark_entry__ as e; names = e.queries(); print(sum(n.startswith('op') for n in names), 'pipeline' in names, len(names) > 90, set(e.oracle_sql()) <= set(names))"


@pytest.mark.parametrize("gone", [(), OPTIONAL[:2], OPTIONAL])
def test_import_in_a_copy(tmp_path, gone):
    copy = tmp_path / "copy"
    left_out = {os.path.join(ROOT, name) for name in gone}
    skipped = shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md", "spark-warehouse")

    def ignored(folder, names):
        return {*skipped(folder, names), *[n for n in names if os.path.join(folder, n) in left_out]}

    shutil.copytree(ROOT, copy, ignore=ignored)
    here = all(os.path.exists(os.path.join(ROOT, name)) for name in OPTIONAL) and not gone
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert ran.stdout.split()[1:] == [str(here), "True", "True"] and (int(ran.stdout.split()[0]) > 0) == here
