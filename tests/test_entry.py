"""The entry where optional parts are gone, and where they are broken."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def queries(folder):
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"],
                         cwd=folder, capture_output=True, text=True, timeout=120, check=False)
    return run.stdout.split() if run.returncode == 0 else run.stderr


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    return tmp_path / "repo"


def test_parts_may_be_gone(copy):
    if not (copy / "trackloom" / "llm").exists():
        assert queries(copy)[2] == "False"
        return
    all_ = queries(copy)
    (copy / "corpus_pipeline.py").unlink()
    assert int(queries(copy)[0]) == int(all_[0]) - 1
    shutil.rmtree(copy / "trackloom" / "llm")
    rest = queries(copy)
    (copy / "trackloom" / "llm" / "__pycache__").mkdir(parents=True)
    assert 100 < int(rest[0]) < int(all_[0]) and queries(copy) == rest


def test_a_mistake_in_a_part_is_an_error(copy):
    part = copy / "trackloom" / "llm" / "queries.py"
    if part.exists():
        part.write_text(part.read_text() + "\nimport trackloom.llm.nothing_of_that_name\n")
        assert "nothing_of_that_name" in queries(copy)
        part.write_text("from trackloom.operators import nothing_of_that_name\n")
        assert "nothing_of_that_name" in queries(copy)
