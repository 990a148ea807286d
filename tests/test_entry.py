"""The driver's entry, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract

REPO = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), len(e.LLM_QUERIES))"
BLOCKED = "import sys; sys.modules['{0}'] = None; " + COUNT


def counts(folder, code):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True)
    return [int(n) for n in done.stdout.split()]


def test_without_the_folders(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse"))
    own = len(contract.queries()) - len(contract.LLM_QUERIES)
    assert counts(tmp_path / "repo", COUNT) == [own, own, 0]


@pytest.mark.parametrize("library", ["tokenizers", "public_tokenizers", "regex"])
def test_without_a_library(library):
    if not contract.LLM_QUERIES:
        pytest.skip("the operators are not there")
    queries, oracles, operators = counts(REPO, BLOCKED.format(library))
    if operators == 0:
        assert queries == oracles
    else:  # imported where it is needed only
        assert queries == len(contract.queries())
