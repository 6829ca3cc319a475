"""The driver's contract holds with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q)"], cwd=tmp_path / "r", capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""})
    n, m, pipeline = said.stdout.split()[-3:]
    assert n == m and int(n) > 30 and pipeline == "False"


def test_nothing_else_imports_the_subpackage():
    for folder, dirs, files in os.walk(os.path.join(ROOT, "patchloom")):
        dirs[:] = [d for d in dirs if d != "llm"]
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f)).read()
