"""The entry module works with and without the optional subpackage."""

import subprocess
import sys

import pytest

CODE = "import sys; {}import __spark_entry__ as e; q = e.queries(); print(len(q), 'master' in q, 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def said(block: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", CODE.format(block)], capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("gone", ["cohortlens.llm", "corpus_pipeline"])
def test_entry_without_the_subpackage(gone):
    made = said(f"sys.modules['{gone}'] = None; ")
    assert made.stdout.split()[1:] == ["True", "False", "True"], made.stderr
