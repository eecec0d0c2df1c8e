"""The entry module works without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def _listed(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def _copy(to, *left_out):
    shutil.copytree(os.path.join(ROOT, "studyloom"), to / "studyloom", ignore=lambda at, names: [n for n in names if n in left_out])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), to / name)


def test_entry_without_operators(tmp_path):
    """The operators are gone, the pipeline's file is still there."""
    _copy(tmp_path, "llm", "__pycache__")
    count, optional, consistent = _listed(tmp_path)
    assert int(count) >= 134 and optional == "False" and consistent == "True"


def test_entry_with_an_empty_folder(tmp_path):
    _copy(tmp_path, "llm", "corpus_pipeline.py", "__pycache__")
    (tmp_path / "studyloom" / "llm" / "__pycache__").mkdir(parents=True)
    assert _listed(tmp_path)[1:] == ["False", "True"]
