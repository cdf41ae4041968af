"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings every job here relies on. Sizes (executor memory, cores, shuffle partition
#: count) belong to the cluster and are deliberately not set.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # partitions are replaced one batch at a time (sources.sinks.replace_batch)
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "billgrid", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder beside the tables of the warehouse, which all executors share
    as well; it is removed when the driver ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _own:
        _own.append(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work-{uuid.uuid4().hex}")
        atexit.register(shutil.rmtree, _own[0].removeprefix("file:"), ignore_errors=True)
    return _own[0]


_scopes: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialized inside live until its end: for jobs that run again and again."""
    name = f"scratch-{uuid.uuid4().hex}"
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: shuffle files of an execution go when it has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several branches read the same expensive intermediate: unlike a cache it
    survives lost executors, and unlike a row checkpoint every branch still gets column
    pruning and filter pushdown. What its shuffles wrote goes with the write. ``outside``
    puts it beside the innermost scratch folder, whose end it outlives.
    """
    spark = df.sparkSession
    scope = _scopes[-2:-1] if outside else _scopes[-1:]
    path = "/".join([work_dir(spark), *scope, f"{name}-{uuid.uuid4().hex}"])
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
