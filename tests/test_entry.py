"""The entry points without the optional parts, in a process of its own."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(x.startswith('op1_') for x in q), sorted(set(o) - set(q)))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_queries_without_the_llm_folders(tmp_path, pipeline):
    for name in ("__spark_entry__.py", "quillgraph", *(["corpus_pipeline.py"] if pipeline else [])):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        if os.path.exists(f"{ROOT}/{name}"):
            copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "quillgraph" / "llm", ignore_errors=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split(" ", 2)[2].strip() == "False False []"


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(f"{ROOT}/quillgraph"):
        for name in names:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(f"{folder}/{name}") as f:
                    assert "quillgraph.llm" not in f.read(), name
