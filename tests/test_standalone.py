"""The library, its entry points and the other queries work without the corpus package."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_corpus_package(tmp_path):
    repo = tmp_path / "repo"
    shutil.copytree(ROOT, repo, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(s) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() for n in q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr[-800:]
