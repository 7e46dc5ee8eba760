"""Python workers need no copy of the package: these run from a folder off its path."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as e
for name in ("op2_lm", "op4_quality", "op6_embeddings", "op9_simhash", "op10_language"):
    assert e.queries()[name](spark, {data!r}).count() > 0, name
print("whole")
"""


def test_workers_off_the_package_path(sf_dir, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, data=small)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.endswith("whole\n"), done.stderr[-3000:]
