"""The entry module, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(x.startswith('op') for x in q), 'pipeline' in q)"


def said(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.rmtree(copy / "wardstone" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    rest = said(copy)
    assert int(rest[0]) > 60 and rest[1:] == ["0", "False"]
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert said(copy) == rest
