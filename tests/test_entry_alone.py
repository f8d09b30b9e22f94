"""The entry module without the optional folders: a copy of the repository that lacks them."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(s) <= set(q))"


def run(folder):
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def copied(to, *without):
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *without))
    return to


def test_without_the_folders(tmp_path):
    for i, without in enumerate((("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",))):
        n, extra, known = run(copied(tmp_path / str(i), *without))
        assert int(n) > 40 and known == "True"
        assert int(extra) == 0 or "llm" not in without
