"""bench.py prints one JSON line with the fields the driver reads."""

import json
import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
               TMPDIR=tempfile.mkdtemp(prefix="gridwork-bench-test-"))
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=900, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert d["unit"] == "sec" and d["sf"] == "0.001" and d["value"] > 0
    assert set(d) >= {"metric", "value", "unit", "queries", "sf"}
    assert len(d["queries"]) == 28 and all(v > 0 for v in d["queries"].values())
