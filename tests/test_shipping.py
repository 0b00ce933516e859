"""Functions travel whole: queries run on executors that have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
NAMES = [
    "e4_grounding", "f1_catalog_match", "f11_near_duplicates", "f13_snippet_join", "h8_domain_breaker", "i6_nearest_in_store",
    "b7_report_files", "l5_rolling_buffer", "l6_streaming_health", "m2_embed", "e12_extract_with_repair",
]


def run(names, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(REPO / "tests" / "shipping.py"), str(REPO), "/root/testdata/sf0.001", *names],
        cwd=cwd, env=env, capture_output=True, text=True, timeout=900,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == len(names)


def test_queries_with_python_in_them(tmp_path):
    run(NAMES, tmp_path)
