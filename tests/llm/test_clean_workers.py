import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
def there(_):
    try:
        import tarnlight
        return ["there"]
    except ImportError:
        return ["not there"]
# spread over all workers: none finds the package on its path
assert set(spark.sparkContext.parallelize(range(8), 8).mapPartitions(there).collect()) == {"not there"}
for name, query in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE, str(REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr[-3000:]
    assert len(got.stdout.split("\n")) == 12
