"""The driver's entry point with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


def names_in(folder):
    run = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_the_other_queries_work_without_the_subpackage(tmp_path, pipeline_stays):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copytree(f"{ROOT}/liveset", copy / "liveset", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline_stays and os.path.exists(f"{ROOT}/corpus_pipeline.py") else [])]:
        shutil.copy(f"{ROOT}/{name}", copy)
    found = names_in(copy)
    assert "knn_topk" in found and "pipeline" not in found and not [n for n in found if n.startswith("op") and n[2:3].isdigit()]
    if os.path.exists(f"{ROOT}/liveset/llm/queries.py"):
        assert set(names_in(ROOT)) - set(found) >= {"pipeline"}
