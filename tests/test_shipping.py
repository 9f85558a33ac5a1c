"""The vector scorer runs in Python workers that cannot import this package (driver started elsewhere)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util, os
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "4").getOrCreate())
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(REPO, "__spark_entry__.py")!r})
mod = importlib.util.module_from_spec(spec); spec.loader.exec_module(mod)
print("ROWS", len(mod.entry(spark).collect()))
"""


def test_entry_from_another_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as d:
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 10" in out.stdout, out.stderr[-2000:]
