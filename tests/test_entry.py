"""The driver's contract, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]


def test_registry():
    import __spark_entry__ as e

    made, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(made) and len(made) > 100


def test_without_llm(tmp_path):
    import shutil

    shutil.copytree(TOP / "loomtrace", tmp_path / "loomtrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [k for k in e.queries() if k.startswith('op') and k[2].isdigit()]; assert 'pipeline' not in e.queries(); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True).returncode == 0


def test_core_does_not_import_llm():
    for p in (TOP / "loomtrace").rglob("*.py"):
        if "llm" not in p.relative_to(TOP / "loomtrace").parts:
            assert "llm" not in p.read_text(), p
