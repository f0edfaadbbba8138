"""The registered queries, and what the rest does without this folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from wavecrate.llm.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[2]


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    for name in ("wavecrate", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_on_whole_tables(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 if name.split("_")[0] not in ("op5", "op7") else df.count() >= 0
