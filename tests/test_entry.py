"""The entry points work without the folders of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TELL = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'redact_documents' in q, any(k.startswith('op') or k == 'pipeline' for k in [*q, *o]))"


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_training_operators(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", TELL], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, twins, flagship, llm = done.stdout.split()
    assert int(n) > 90 and int(twins) > 90 and flagship == "True" and llm == "False"
