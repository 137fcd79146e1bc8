"""The entry module with and without the optional operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_optional_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and len(q) > 150 and set(o) == set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, timeout=120)


def test_errors_inside_the_package_are_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", ".pytest_cache"))
    (copy / "siteweave" / "llm").mkdir()
    (copy / "siteweave" / "llm" / "__init__.py").write_text("import no_such_module\n")
    (copy / "corpus_pipeline.py").write_text("import siteweave.llm\n")
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode and "no_such_module" in run.stderr


def test_nothing_else_names_the_package():
    for path in (ROOT / "siteweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert ".llm" not in path.read_text(), path
