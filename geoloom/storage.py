"""Tables kept between the steps of a job, in the folder all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders made for sessions that name none, by application.
_made: dict[str, str] = {}
#: Folders of the jobs that run in this thread (or task of an event loop), the innermost last.
_running: ContextVar[tuple[str, ...]] = ContextVar("_running", default=())
#: Row limits in force by session, and what held before the first of them.
_limits: dict[int, tuple[str, list[int]]] = {}
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine), a folder is made and
    used for the rest of the session. On a cluster the warehouse is used instead,
    since a machine's own temp folder isn't seen by the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _made:
        if spark.sparkContext.master.startswith("local"):
            _made[app] = "file://" + tempfile.mkdtemp(prefix="spark-geoloom-")
        else:
            _made[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
    return _made[app]


def _remove(spark: SparkSession, path: str, now: bool) -> None:
    """Remove a folder, now or when the session ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if now:
        files.delete(where, True)
    else:
        files.deleteOnExit(where)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Within the block, tables of ``materialize`` belong to this job and are removed at its end, but for those of ``result``. Jobs of several threads don't know of each other."""
    path = f"{shared_dir(spark)}/steps/{uuid.uuid4().hex}"
    before = _running.set((*_running.get(), path))
    try:
        yield
    finally:
        _running.reset(before)
        _remove(spark, path, now=True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that a job writes itself; it lasts as a table of ``materialize`` does."""
    running = _running.get()
    path = f"{running[-1] if running else shared_dir(spark) + '/steps'}/{name}-{uuid.uuid4().hex}"
    if not running:
        _remove(spark, path, now=False)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    This cuts the lineage, so an executor lost later costs a reread and not a
    recomputation, and a table used twice is computed once. Within a ``job`` the
    table lasts as long as the job, else as long as the session.
    """
    running = _running.get()
    return _written(df, f"{running[-1]}/{name}-{uuid.uuid4().hex}") if running else result(df, name)


def result(df: DataFrame, name: str) -> DataFrame:
    """As ``materialize``, for what a job hands out: the table lasts as long as the session (or the job around this one)."""
    spark = df.sparkSession
    outer = _running.get()[:-1]
    path = f"{outer[-1] if outer else shared_dir(spark) + '/steps'}/{name}-{uuid.uuid4().hex}"
    if not outer:
        _remove(spark, path, now=False)
    return _written(df, path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within the block, jobs that are run hand at most ``n`` rows at a time to Python workers. For rows that are long. Of several blocks, in any threads, the smallest limit holds until the last has ended."""
    key, session = "spark.sql.execution.arrow.maxRecordsPerBatch", id(spark)
    with _lock:
        before, limits = _limits.setdefault(session, (spark.conf.get(key), []))
        limits.append(n)
        spark.conf.set(key, str(min(limits)))
    try:
        yield
    finally:
        with _lock:
            limits.remove(n)
            spark.conf.set(key, str(min(limits)) if limits else before)
            if not limits:
                del _limits[session]


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], rows: str | None = None) -> DataFrame:
    """``df`` with the sums of all rows before each row in a total ``order``, and their number as ``rows``, without bringing them to one task.

    Rows are dealt by ranges of the order and written; only a row per range is
    summed up in one place.
    """
    sums = sums | ({rows: F.lit(1).cast("bigint")} if rows else {})
    ranged = materialize(df.withColumn("_order", F.struct(*order)).repartitionByRange(F.col("_order")).withColumns({"_range": F.spark_partition_id(), **{f"_own_{k}": c for k, c in sums.items()}}), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_own_{k}").alias(f"_all_{k}") for k in sums])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_start_{k}") for k in sums])
    within = W.partitionBy("_range").orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumns({k: F.coalesce(F.sum(f"_own_{k}").over(within), F.lit(0)) for k in sums}).join(starts, "_range")
    return out.withColumns({k: F.col(k) + F.col(f"_start_{k}") for k in sums}).select(*df.columns, *sums)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows numbered from 0 in the order of a unique ``key``, without bringing them to one task."""
    return running_sums(df, [F.col(key)], {}, rows="number")
