"""Queries that run Python on the executors, with the package on the driver's path alone."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from tessera import session
from tessera.operators import search
from tessera.plans import registry
from tessera.plans.search import calm
spark = session.build("ship", cpus=2)
spark.conf.set("spark.sql.shuffle.partitions", "2")
for name in ("macd_history", "signals_directional", "signal_macd_cross", "stories_72h"):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
assert search.leaderboard(calm(spark, "/root/testdata/sf0.001"), "macd_cross").count() > 0
print("all ran")
"""


def test_package_off_the_path_of_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]
