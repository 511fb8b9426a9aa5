"""The entry module without the llm folders, and with one that can't be imported."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def count(folder: Path) -> tuple[int, int, str]:
    """Queries and text queries that the entry module of a folder has, and what it said."""
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q) + ('pipeline' in q)); assert set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    a, b = out.stdout.split()[-2:]
    return int(a), int(b), out.stderr


def test_entry_without_llm(tmp_path):
    shutil.copytree(REPO / "headway", tmp_path / "headway", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    alone, none, said = count(tmp_path)
    assert none == 0 and alone > 200 and "left out" not in said
    (tmp_path / "headway/llm").mkdir()
    (tmp_path / "headway/llm/queries.py").write_text("import a_library_that_is_absent\n")
    (tmp_path / "headway/llm/__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("from headway.llm import queries\n")
    broken, none, said = count(tmp_path)
    assert (broken, none) == (alone, 0) and "left out" in said
