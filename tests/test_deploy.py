"""The package reaches Python workers even when the driver runs elsewhere."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from quillspark import registry
df = registry.queries()["generate_stub"](spark, "/root/testdata/sf0.001")
print("ROWS", df.filter("generated IS NOT NULL").count())
"""


def test_python_stages_run_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="quillspark-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    rows = [line for line in out.stdout.splitlines() if line.startswith("ROWS")]
    assert rows and int(rows[0].split()[1]) > 0
