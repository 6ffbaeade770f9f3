"""The driver may import __spark_entry__ from anywhere: Python workers must not need to import
this repository (closures sent to them travel by value)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
from __spark_entry__ import queries
q = queries()
print("ROWS", q["retry_failed"](spark, "/root/testdata/sf0.001").count(),
      q["ranked_candidates"](spark, "/root/testdata/sf0.001").count())
"""


def test_scoring_runs_from_foreign_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-3000:]


LOAD_BY_PATH = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("driver_entry", {REPO!r} + "/__spark_entry__.py")
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
print("ROWS", module.entry(spark).count(), len(module.queries()), len(module.oracle_sql()))
"""


def test_entry_loads_by_file_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LOAD_BY_PATH], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-3000:]
