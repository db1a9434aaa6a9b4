"""The library without the training-data operators: registry and SQL still load."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("mnemex/llm", "tests/llm"), ("mnemex/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
@pytest.mark.parametrize("caches", [False, True])
def test_registry_loads_without_them(tmp_path, gone, caches):
    home = tmp_path / "copy"
    shutil.copytree(ROOT, home, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = home / name
        if path.is_dir():
            shutil.rmtree(path)
            if caches:
                (path / "__pycache__").mkdir(parents=True)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 200; print('pipeline' in q, any(n.startswith('op1_') for n in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=home, capture_output=True, text=True, timeout=120)
    there = (home / "mnemex/llm/__init__.py").exists()
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == ["False", str(there)]
