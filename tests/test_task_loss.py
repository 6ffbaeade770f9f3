"""A task that dies mid-scoring is re-run by Spark; the written results hold every row once."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import os, sys
sys.path.insert(0, {REPO!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
from scorekit.operators.batches import pack_batches
from scorekit.operators.numbering import assign_ids
from scorekit.operators.responses import batch_results
from scorekit.operators.scoring import score_batches
from local_scorer import field_scorer

inner = field_scorer("k")

def dying(batch_id, payload, prompt):
    if batch_id == 2 and TaskContext.get().attemptNumber() == 0:
        os._exit(3)          # the Python worker disappears mid-task
    return inner(batch_id, payload, prompt)

df = assign_ids(spark.range(0, 400).select(F.col("id").alias("k")), "k")
scored = score_batches(pack_batches(df, batch_size=50), dying, "r", parallelism=2)
res = batch_results(scored)
print("RESULT", scored.where("outcome = 'ok'").count(), res.count(),
      res.select("unique_id").distinct().count())
"""


def test_lost_task_is_rerun_and_results_are_whole(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True,
                         text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("RESULT")]
    assert line, out.stderr[-3000:]
    assert "Lost task" in out.stderr          # the fault really happened
    assert line[0].split()[1:] == ["8", "400", "400"]
