import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(sf):
        name = f.removesuffix(".parquet")
        c.sql(f"create view {name} as select * from '{sf}/{f}'")
    return c


def same(frame, relation):
    """Spark rows and DuckDB rows as comparable lists."""
    order = [relation.columns.index(c) for c in frame.columns]
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted((tuple(cell(v) for v in row) for row in frame.collect()), key=repr)
    b = sorted((tuple(cell(row[i]) for i in order) for row in relation.fetchall()), key=repr)
    return a, b


@pytest.fixture(scope="session")
def compare():
    return same
