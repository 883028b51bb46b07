import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from roomdiff.shipping import ship
from roomdiff.operators.components import components
ship(spark, {folder!r})
vox = spark.createDataFrame([("a", v) for v in (0, 1, 50)], "set_id string, vox bigint")
print("COMPONENTS", components(vox).select("comp").distinct().count())
"""


def test_a_job_started_in_another_folder_finds_the_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "COMPONENTS 2" in out.stdout, out.stderr[-2000:]
