"""The models' tasks run on workers that have no copy of the package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("cohortide") is None).first()
sys.path.insert(0, sys.argv[1])  # the driver alone
from cohortide.operators import models
cells = spark.range(4000).selectExpr(
    "102 AS study_id", "302 AS outcome_id", "'All' AS slice", "if(id % 2 = 0, 'Male', 'Female') AS gender", "CAST(20 + id % 61 AS INT) AS age",
    "id % 7 / 3D AS months", "CAST(id % 3 = 0 AS INT) AS mask", "1L AS n", "CAST(pmod(xxhash64(id), 5) = 0 AS LONG) AS y")
cubes = models._cubes(cells.withColumn("y", F.lit(0)), ["study_id", "slice"]).drop("y")
changes = models._cubes(cells.withColumn("n", F.lit(0)), models.SLICE)
got = models.odds_ratios(cubes, changes, models.covariate_patterns(cubes, changes)).where("var = 'asthma'").collect()
assert len(got) == 3 and all(r.status == "converged" for r in got), got
print("all ran")
"""


def test_models_run_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "all ran" in done.stdout, done.stderr[-2000:]
