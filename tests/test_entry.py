"""What the contract offers where the package for training data, or a library of its own, is absent."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.modules[{absent!r}] = None
import warnings
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as contract
names = contract.queries()
assert "row_diff" in names and set(contract.oracle_sql()) <= set(names)
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
print(len(names), [str(w.message) for w in told if "training data" in str(w.message)])
"""


@pytest.mark.parametrize("absent", ["countercheck.llm", "corpus_pipeline", "xxhash"])
def test_other_queries_stay(absent):
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(absent=absent)], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-800:]
    if absent == "xxhash" and (ROOT / "countercheck/llm").is_dir():
        assert "xxhash" in run.stdout
