"""The entry module without the optional subpackage, and with only a leftover folder of it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), 'p1_found' in q, 'p2_found' in q)"


def _run(folder):
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, capture_output=True, text=True, check=True).stdout.split()[1:]


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "replicata"), tmp_path / "replicata", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.rmtree(tmp_path / "replicata" / "llm", ignore_errors=True)
    assert _run(tmp_path) == ["True", "True", "False"]
    (tmp_path / "replicata" / "llm" / "__pycache__").mkdir(parents=True)
    assert _run(tmp_path) == ["True", "True", "False"]
