"""The entry point without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_training_data(tmp_path):
    """With both llm folders gone, with or without the pipeline's module, the library's own queries are all there."""
    there = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "a", ignore=there)
    shutil.copytree(ROOT, tmp_path / "b", ignore=lambda d, names: {*there(d, names), "corpus_pipeline.py"})
    code = "import __spark_entry__ as e; from chronogrid.plans import catalog; q, s = e.queries(), e.oracle_sql(); assert set(q) == set(catalog.QUERIES) and len(q) >= 42 and set(s) <= set(q); print(len(q))"
    for name in "ab":
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / name, env=os.environ | {"PYTHONPATH": str(tmp_path / name)}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
