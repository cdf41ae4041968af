"""Stored tables that are kept by key: partitions by a hash of the key (S6-S8, S10, ST2, ST10).

A batch reads and replaces only the partitions that its own keys fall into. The hash spreads keys
evenly, so a key or owner that is much more frequent than others doesn't make a partition larger:
there is one row for each key. Choose ``buckets`` by the size that the table will have; it can't
change afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from billgrid.session import materialize, scratch
from billgrid.sources import sinks

BUCKETS = 256
BUCKET = "key_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def children(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Names below ``path`` that fit ``pattern``, relative to it."""
    fs, at = _path(spark, f"{path}/{pattern}")
    depth = pattern.count("/") + 1
    return ["/".join(x.getPath().toString().rsplit("/", depth)[1:]) for x in fs.globStatus(at) or ()]


def _replace_partitions(rows: DataFrame, path: str, *columns: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


class KeyedTable:
    """One row for each key of ``keys`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        schema = StructType(list(self.schema.fields)).add(BUCKET, IntegerType())
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def touched(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; the filter is one on partitions."""
        return self._stored().filter(F.col(BUCKET).isin(*buckets)).drop(BUCKET)

    def upsert(self, updates: DataFrame, merge: Merge, batch_id: int) -> None:
        """Merge a batch into the partitions that it touches; ``merge`` takes their rows and the batch's.

        The merged partitions are first written beside the table and then put in place by Spark's
        dynamic partition overwrite. A batch that is run again, after a failure at any point, puts the
        same partitions in place: they stay beside the table until the next batch has begun. So a
        batch id must name the same rows each time. Empty batches change nothing.
        """
        staged = f"{self.path}.staged/batch={batch_id:012d}"
        if not exists(self.spark, f"{staged}/_SUCCESS"):
            with scratch(self.spark):
                batch = materialize(updates.withColumn(BUCKET, bucket_of(self.keys, self.buckets)), "updates")
                buckets = [r[0] for r in batch.select(BUCKET).distinct().collect()]
                merged = merge(self.touched(buckets), batch.drop(BUCKET)).select(*self.schema.names)
                # partitions by bucket, where Spark splits large and joins small ones
                placed = merged.withColumn(BUCKET, bucket_of(self.keys, self.buckets)).hint("rebalance", BUCKET)
                placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(staged)
        if children(self.spark, staged, f"{BUCKET}=*"):
            schema = StructType(list(self.schema.fields)).add(BUCKET, IntegerType())
            _replace_partitions(self.spark.read.schema(schema).parquet(staged).hint("rebalance", BUCKET), self.path, BUCKET)
        for name in children(self.spark, f"{self.path}.staged"):
            if name < f"batch={batch_id:012d}":
                delete(self.spark, f"{self.path}.staged/{name}")

    def upsert_latest(self, updates: DataFrame, order: str, batch_id: int) -> None:
        """S6 into the stored table."""
        self.upsert(updates, lambda old, new: sinks.upsert_latest(old, new, self.keys, order), batch_id)

    def upsert_coalesce(self, updates: DataFrame, keep_cols: list[str], batch_id: int, fixed: dict | None = None) -> None:
        """S7 into the stored table; a key stands once in ``updates``."""
        self.upsert(updates, lambda old, new: sinks.upsert_coalesce(old, new, self.keys, keep_cols, fixed), batch_id)

    def upsert_columns(self, updates: DataFrame, cols: list[str], batch_id: int) -> None:
        """S8 into the stored table; a key stands once in ``updates``."""
        self.upsert(updates, lambda old, new: sinks.upsert_columns(old, new, self.keys, cols), batch_id)


class KeyLog:
    """Keys that were ever admitted, and by which batch (ST2).

    A batch adds a part to each bucket that its keys fall into and reads no other bucket. A bucket of
    more than ``most_parts`` parts is rewritten as one by the batch that meets it, so the number of
    files stays within buckets times parts, however many batches there were.
    """

    SCHEMA = f"unique_key string, batch long, {BUCKET} int, part string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most_parts: int = 16):
        self.spark, self.path, self.buckets, self.most_parts = spark, path.rstrip("/"), buckets, most_parts

    def known(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """unique_key of the earlier batches' keys in the buckets of ``batch``: a batch that is run again
        doesn't meet its own."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "unique_key string")
        buckets = [r[0] for r in batch.select(bucket_of(["unique_key"], self.buckets)).distinct().collect()]
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.filter(F.col(BUCKET).isin(*buckets) & (F.col("batch") < batch_id)).select("unique_key")

    def add(self, admitted: DataFrame, batch_id: int) -> None:
        rows = admitted.select("unique_key", F.lit(batch_id).cast("long").alias("batch"), bucket_of(["unique_key"], self.buckets), F.lit(f"b{batch_id:012d}").alias("part"))
        _replace_partitions(rows.hint("rebalance", BUCKET), self.path, BUCKET, "part")
        self._rewrite(batch_id)

    def _rewrite(self, batch_id: int) -> None:
        """Full buckets as one part each, of the batches before this one. The old parts go only once the
        new one is in place; until then a key may stand in both, which changes no anti-join."""
        parts: dict[str, list[str]] = {}
        for name in children(self.spark, self.path, f"{BUCKET}=*/part=*"):
            bucket, part = name.split("/part=")
            if part[1:] < f"{batch_id:012d}" or part == f"c{batch_id:012d}":
                parts.setdefault(bucket.removeprefix(f"{BUCKET}="), []).append(part)
        whole = f"c{batch_id:012d}"
        done = [b for b, names in parts.items() if whole in names]
        full = [b for b, names in parts.items() if whole not in names and len(names) > self.most_parts]
        if full:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path).filter(F.col(BUCKET).isin(*map(int, full)) & (F.col("batch") < batch_id))
            once = rows.groupBy(BUCKET, "unique_key").agg(F.min("batch").alias("batch")).select("unique_key", "batch", BUCKET, F.lit(whole).alias("part"))
            _replace_partitions(once.hint("rebalance", BUCKET), self.path, BUCKET, "part")
        for b in full + done:
            for part in parts[b]:
                if part != whole:
                    delete(self.spark, f"{self.path}/{BUCKET}={b}/part={part}")
