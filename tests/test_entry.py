"""The entry point without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_parts(tmp_path):
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, copy, ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, capture_output=True, text=True)
    n, with_sql = map(int, out.stdout.split())
    assert n >= 70 and with_sql >= 70


def test_nothing_else_imports_the_optional_parts():
    for folder, _, names in os.walk(os.path.join(ROOT, "epilane")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert "epilane.llm" not in open(os.path.join(folder, name)).read(), name
