"""The entry file without the training-data operators."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["leadflow.llm", "corpus_pipeline", "xxhash", "tokenizers", "public_tokenizers"])
def test_other_queries_stay(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    names = done.stdout.split()
    assert done.returncode == 0 and "campaign" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
