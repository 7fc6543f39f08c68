"""The driver imports __spark_entry__ by path from another working
directory; Python-worker operators must not need the package on the
executors' path."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_by_path", {os.path.join(ROOT, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", E.queries()["mlp_score"](spark, "/root/testdata/sf0.001").count(),
      E.queries()["knn_classify"](spark, "/root/testdata/sf0.001").count(), E.entry(spark).count())
spark.stop()
"""


def test_python_worker_queries_from_another_cwd():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(), env=env,
                         capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    n_mlp, n_knn, n_entry = map(int, line[0].split()[1:])
    assert n_mlp > 0 and n_knn > 0 and n_entry >= 0
