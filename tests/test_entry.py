"""The entry gives its core queries whether or not the subpackage and the pipeline are there."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from themescope.plans import queries as core

ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [("themescope/llm",), ("themescope/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without(tmp_path, gone):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", "metastore_db", "spark-warehouse"))
    had_llm = (at / "themescope/llm").exists()
    for name in gone:
        path = at / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=at, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    named, with_sql = (set(line.split()) for line in said.stdout.strip().split("\n"))
    assert set(core.QUERIES) <= named and set(core.QUERIES_SQL) <= with_sql
    assert "pipeline" not in named
    assert any(n.startswith("op") for n in named) == (had_llm and "themescope/llm" not in gone)


def test_what_the_subpackage_lacks_is_an_error(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    if not (at / "themescope/llm").exists():
        pytest.skip("no subpackage")
    (at / "themescope/llm/common.py").unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", ASK], cwd=at, env=env, capture_output=True, timeout=120).returncode
