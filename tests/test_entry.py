"""The driver contract, with and without the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def counts(at):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=at, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return tuple(map(int, out.stdout.split()))


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_llm_folders(tmp_path, pipeline):
    """Both folders deleted, the pipeline's file left or not: everything else is still registered."""
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, tmp_path / "copy", ignore=skip)
    n, of_llm = counts(tmp_path / "copy")
    assert n > 40 and of_llm == 0


@pytest.mark.skipif(not (REPO / "corpuscle/llm").is_dir(), reason="the operators are not here")
def test_every_training_data_operator_is_registered():
    assert counts(REPO)[1] == 14  # thirteen operators and the pipeline
