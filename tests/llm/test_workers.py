"""Models reach workers that have no copy of the package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m").config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("cohortide") is None).first()
sys.path.insert(0, sys.argv[1])  # the driver alone
from cohortide.llm.registry import QUERIES
for name in ("op2_quality", "op4_html_extract", "op8_toxicity", "op10_topk", "op12_phrases", "op13_spelling"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0, name
print("all ran")
"""


def test_models_run_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT, f"file://{tmp_path}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400, check=False)
    assert "all ran" in done.stdout, done.stderr[-2000:]
