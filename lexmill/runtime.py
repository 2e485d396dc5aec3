"""Sessions, tables and durable intermediate results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_paths: dict[str, list[str]] = {}


def session(name: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; the cluster's own settings win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master has a temporary one, which ends with the process; on a cluster
    that is an error, because executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, executors may be lost.

    ``forget`` deletes what a session has written; until then the result may be read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this session has written; their number. Call it when results are stored."""
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores where it has parts for half of them at most, as a table of one row group has.

    Only a small input has so few parts; a larger one is left alone, so its rows are not shuffled. A plan that
    already has a shuffle, and a stream, are left alone too.
    """
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() * 2 <= n else df


def take_bounded(df: DataFrame, limit: int, what: str) -> list:
    """All rows of a table that must be small; fails, without dropping any, if it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it can't be sent to every executor")
    return rows


def small(df: DataFrame, limit: int, what: str) -> DataFrame:
    """``df`` marked for broadcast after its rows were counted; beyond ``limit`` it is left to the planner.

    ``what`` names the table for readers of the call.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def with_index(df: DataFrame, order: str, name: str = "ix") -> DataFrame:
    """``df`` with a 0-based position in the order of a unique column, without a one-task window.

    The rows are range-partitioned and written once; positions are the place in the partition
    plus the rows of the partitions before, of which only the counts are brought together.
    """
    place = F.monotonically_increasing_id()
    rows = written(df.orderBy(order).withColumn("__at", place), "ordered")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    out = rows.withColumn("__part", part).join(F.broadcast(first), "__part")
    index = (F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long")
    return out.withColumn(name, index).drop("__part", "__at", "__first")
