import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"


@pytest.mark.parametrize("gone", [("budgetlens/llm", "tests/llm"), ("budgetlens/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, n_sql, *others = done.stdout.split()
    assert int(n) >= int(n_sql) > 40 and not others
