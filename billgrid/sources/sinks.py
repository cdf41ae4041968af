"""Writers and keyed merges.

Merges are DataFrame operations, so any table format can hold the result. They are built from
mergeable aggregates and equi-joins on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_latest(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins. Per key the update with the highest ``order`` replaces the row."""
    cols = target.columns
    rows = target.select(*cols, F.lit(0).alias("_src")).unionByName(updates.select(*cols, F.lit(1).alias("_src")))
    value = F.struct(*[c for c in cols if c not in keys])
    # an update replaces the stored row even when the stored row claims a later time
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct("_src", order)).alias("v")).select(*keys, "v.*").select(*cols)


def upsert_coalesce(target: DataFrame, updates: DataFrame, keys: list[str], keep_cols: list[str], fixed: dict | None = None) -> DataFrame:
    """New values win, but a NULL never erases what is known in ``keep_cols``.

    ``fixed`` sets columns to a constant on every touched row (status active, error cleared).
    """
    t, u = target.alias("t"), updates.alias("u")
    cond = [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    touched = F.coalesce(F.col("u._hit"), F.lit(False))
    joined = t.join(updates.withColumn("_hit", F.lit(True)).alias("u"), on, "full_outer")
    out = []
    for c in target.columns:
        new = F.col(f"u.{c}") if c in updates.columns else F.lit(None)
        if c in keys:
            col = F.coalesce(F.col(f"t.{c}"), new)
        elif fixed and c in fixed:
            col = F.when(touched, F.lit(fixed[c])).otherwise(F.col(f"t.{c}"))
        elif c in keep_cols or c not in updates.columns:
            col = F.coalesce(new, F.col(f"t.{c}"))
        else:
            col = F.when(touched, new).otherwise(F.col(f"t.{c}"))
        out.append(col.cast(target.schema[c].dataType).alias(c))
    return joined.select(*out)


def upsert_columns(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """On conflict only ``cols`` change; unknown keys are added."""
    new = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    kept = target.join(new, keys, "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in target.columns]
    )
    return kept.unionByName(updates.join(target, keys, "left_anti").select(*[c for c in target.columns if c in updates.columns]), allowMissingColumns=True)


def append_runs(df: DataFrame, path: str) -> None:
    """Append-only log of parse runs."""
    df.write.mode("append").parquet(path)


def replace_batch(df: DataFrame, path: str, batch_id: str) -> None:
    """Replace one batch and leave the others alone; a batch without rows is emptied."""
    if df.isEmpty():
        spark = df.sparkSession
        batch = spark._jvm.org.apache.hadoop.fs.Path(path, f"batch_id={batch_id}")
        batch.getFileSystem(spark._jsc.hadoopConfiguration()).delete(batch, True)
        return
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def audit_rows(**parts: DataFrame) -> DataFrame:
    """Per document one JSON record of the given one-row-per-document tables."""
    names = list(parts)
    out = None
    for name in names:
        df = parts[name]
        one = df.select("doc_id", F.struct(*[c for c in df.columns if c != "doc_id"]).alias(name))
        out = one if out is None else out.join(one, "doc_id", "full_outer")
    return out.select("doc_id", F.to_json(F.struct(*names)).alias("audit"))


def write_audit(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def backfill_keys(jobs: DataFrame, known: DataFrame, types) -> DataFrame:
    """A3: dedupe keys of finished durable work, merged with the keys already known."""
    new = (
        jobs.filter((F.col("status") == "completed") & F.col("type").isin(*types)).groupBy("unique_key")
        .agg(F.max("type").alias("n_type"), F.min("created_at").alias("n_first"), F.max("updated_at").alias("n_last"))
    )
    return known.join(new, "unique_key", "full_outer").select(
        "unique_key", F.coalesce("n_type", "type").alias("type"), F.least("first_seen_at", "n_first").alias("first_seen_at"),
        F.coalesce("completed_at", "n_last").alias("completed_at"), F.greatest("updated_at", "n_last").alias("updated_at"),
    )


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when the table is sound."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
