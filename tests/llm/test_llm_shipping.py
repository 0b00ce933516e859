"""Functions travel whole: the operators run on executors that have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

from marketloom.llm.queries import LLM_QUERIES

REPO = Path(__file__).resolve().parents[2]


def test_operators(tmp_path):
    names = sorted(LLM_QUERIES)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(REPO / "tests" / "shipping.py"), str(REPO), "/root/testdata/sf0.001", *names],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == len(names)
