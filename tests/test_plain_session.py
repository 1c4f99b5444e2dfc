"""Streams run in a session that is not the library's own: another folder, no PYTHONPATH, default state provider."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", {shared!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from secstream.plans.queries import all_queries
named = all_queries()
for name in ("stream_threshold_alerts", "stream_travel_alerts", "stream_hijack_alerts"):
    print("ROWS", name, named[name](spark, "/root/testdata/sf0.001").count())
assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")
"""


def test_stateful_streams_in_a_plain_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    job = JOB.format(root=ROOT, shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = {line.split()[1]: int(line.split()[2]) for line in done.stdout.splitlines() if line.startswith("ROWS")}
    assert len(rows) == 3 and rows["stream_threshold_alerts"] > 0
