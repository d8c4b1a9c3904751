"""The entry point with and without the optional parts, each in a fresh process."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') for n in q), 'pipeline' in q, 'knn_hamming' in q)"


@pytest.mark.parametrize("without", [("ashlar/llm",), ("ashlar/llm", "corpus_pipeline.py"), ("ashlar/llm/queries.py",)])
def test_entry_without_the_optional_parts(tmp_path, without):
    skip = shutil.ignore_patterns("__pycache__", "tests", ".*")
    for name in ("ashlar", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=skip)
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    for name in without:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[-3:] == ["0", "False", "True"]
