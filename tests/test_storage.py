"""Step tables: where they are kept, and for how long."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from geoloom import storage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
from pyspark.sql import SparkSession
from geoloom.storage import materialize, numbered
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("ROWS", materialize(spark.range(7), "a").count(), numbered(spark.range(5), "id").count())
"""


def test_a_session_that_names_no_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 7 5" in out.stdout, out.stderr[-2000:]


def test_step_tables_go_with_their_job(spark):
    with storage.job(spark):
        inner = storage.materialize(spark.range(3), "inner")
        (step,) = {os.path.dirname(f) for f in inner.inputFiles()}
        with storage.job(spark):
            kept = storage.result(storage.materialize(inner, "deeper").withColumn("x", F.lit(1)), "handed-out")
            assert kept.count() == 3
        assert kept.count() == 3  # it belongs to the job around
        out = storage.result(kept, "out")
    assert out.count() == 3
    assert not os.path.exists(step.removeprefix("file://").removeprefix("file:"))


def test_running_sums_in_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    rows = storage.running_sums(df, [-F.col("k")], {"before": F.col("v")}, rows="number").collect()
    want, total = {}, 0
    for n, k in enumerate(range(999, -1, -1)):
        want[k] = (total, n)
        total += k % 7
    assert {r["k"]: (r["before"], r["number"]) for r in rows} == want


def test_jobs_of_two_threads_keep_their_own_tables(spark):
    """The job that ends first takes nothing of the other's with it, nor its limit of rows."""
    import threading

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    first, second, seen = threading.Event(), threading.Event(), {}

    def long() -> None:
        with storage.arrow_rows(spark, 50), storage.job(spark):
            table = storage.materialize(spark.range(11), "long")
            first.set()
            second.wait(60)
            seen["long"] = table.count(), spark.conf.get(key)

    def short() -> None:
        first.wait(60)
        with storage.arrow_rows(spark, 20), storage.job(spark):
            storage.materialize(spark.range(5), "short")
            seen["short"] = spark.conf.get(key)
        second.set()

    threads = [threading.Thread(target=f) for f in (long, short)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"long": (11, "50"), "short": "20"} and spark.conf.get(key) == before


def test_scratch_goes_with_its_job(spark):
    with storage.job(spark):
        path = storage.scratch(spark, "files")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert not os.path.exists(path.removeprefix("file://"))
