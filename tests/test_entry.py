import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print('pipeline' in q, any(k.startswith('op1_') for k in q), len(q) > 40)"


@pytest.mark.parametrize("gone", [["tidepanel/llm", "tests/llm"], ["tidepanel/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_works_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in gone:
        found = copy / path
        shutil.rmtree(found, ignore_errors=True) if not found.is_file() else found.unlink()
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == ["False", "False", "True"]
