"""The library and its entry point stand without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = """
import __spark_entry__ as e
names = set(e.queries())
assert names and set(e.oracle_sql()) <= names and callable(e.entry), names
assert not any(n.startswith("op") and n[2:3].isdigit() for n in names) and (("pipeline" in names) is False), names
"""


def _copy(to, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", *without)
    shutil.copytree(ROOT, to, ignore=skip)
    return to


def test_entry_without_the_subpackage(tmp_path):
    for kind, without in (("folders", ("llm",)), ("pipeline-too", ("llm", "corpus_pipeline.py"))):
        copy = _copy(tmp_path / kind, *without)
        assert not (copy / "bandnet" / "llm").exists() and not (copy / "tests" / "llm").exists()
        done = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert done.returncode == 0, done.stderr
