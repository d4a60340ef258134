"""The queries run from any working directory: the Python workers get the
package shipped by the session, not from the driver's path.  The corpus
operators can be left out."""

import os
import shutil
import subprocess
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
import __spark_entry__ as E
print("ROWS", E.queries()["knn_items"](spark, "/root/testdata/sf0.001").count())
"""


def test_knn_runs_outside_the_repo():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.gettempdir(), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("without", [[], ["corpus_pipeline.py"]])
def test_entry_imports_without_the_corpus_operators(tmp_path, without):
    """With their folders deleted (and the pipeline or not), the other queries are all there."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *without)
    shutil.copytree(REPO, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True,
                          env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})
    assert said.returncode == 0, said.stderr
    from cartlens.plans.queries import QUERIES
    assert said.stdout.split() == [str(len(QUERIES)), "False", "True"]
