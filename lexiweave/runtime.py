"""Shared run-time helpers: shared scratch tables and distributed running totals.

Nothing here touches a machine-local folder on a cluster: scratch tables go to
the folder named by ``spark.checkpoint.dir``; only where that is unset (tests,
a laptop) a folder under the system's temporary directory is used.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Only a ``local`` master may do without: driver and executors are one machine there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (set_dir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = set_dir.get()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="lexiweave-")
    return _LOCAL_SCRATCH[app]


def _job_root(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/lexiweave/{spark.sparkContext.applicationId}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written while one job runs; ``drop`` removes those no longer needed.

    A written table cuts the lineage and survives a lost executor, as every
    executor reads it from the shared folder. So the shuffle files of the job
    that wrote it are not needed any more, and go at its end. Tables that a
    result still reads stay until ``close`` or ``release``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{_job_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written rows."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._lexiweave_path = path
        return kept

    def drop(self, kept: DataFrame | None) -> None:
        """Delete a table that ``keep`` wrote, when nothing reads it any more."""
        path = getattr(kept, "_lexiweave_path", None)
        if path:
            delete(self.spark, path)

    def close(self) -> None:
        """Delete all tables of this Scratch, when no result that reads them is needed any more."""
        delete(self.spark, self.root)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results that still read one must have been written before."""
    delete(spark, _job_root(spark))


def hash_buckets(rows: int, least: int = 2048) -> int:
    """How many hash buckets to deal rows over: buckets of ``least`` rows, or as large as they are many."""
    return max(16, -(-rows // max(least, math.isqrt(rows))))


def running_total(
    df: DataFrame,
    *,
    group: Sequence[str],
    buckets: dict[str, Column],
    order: Sequence[str],
    out: str,
    value: Column | None = None,
) -> DataFrame:
    """Exclusive running total of ``value`` (rows, if None) within each group.

    The order is first by the bucket columns, then by ``order`` inside a
    bucket; group and bucket columns must not be null. No group is ever brought into one task: only one row per
    (group, bucket) is, so a group may hold any share of the rows.
    """
    value = F.lit(1).cast("long") if value is None else value.cast("long")
    names = [f"__bucket_{k}" for k in buckets]
    keyed = df.withColumns(dict(zip(names, buckets.values(), strict=True)) | {"__value": value})
    keys = [*group, *names]
    totals = keyed.groupBy(*keys).agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.join(offsets, keys)
    return joined.withColumn(
        out, (F.col("__offset") + F.coalesce(F.sum("__value").over(inside), F.lit(0))).cast("long")
    ).drop(*names, "__value", "__offset")


def running_total_by_order(df: DataFrame, order: Sequence[str], out: str, value: Column | None = None) -> DataFrame:
    """Exclusive running total of ``value`` (rows, if None) over all rows in the order of ``order``.

    The rows are cut into ranges of the order and written once, so that a range
    keeps its rows; only one row a range passes through one task.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    kept = Scratch(spark, "ranges").keep(cut, "ranges")
    return running_total(kept, group=[], buckets={"range": F.col("__range")}, order=order, out=out, value=value).drop("__range")
