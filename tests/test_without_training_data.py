"""The rest of the library without the training-data folders."""

import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_folders(tmp_path, pipeline):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *() if pipeline else ("corpus_pipeline.py",)))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'R11' in q and not any(k[:3] in ('op1', 'pip') for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr
