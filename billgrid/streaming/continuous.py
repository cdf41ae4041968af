"""Continuous decisioning (ST10, ST2 as a sink)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from billgrid import schemas
from billgrid.operators import decide, extract, match, normalize
from billgrid.session import materialize, scratch
from billgrid.sources.cursors import known_cursors, read_feed
from billgrid.sources.keyed import BUCKET, BUCKETS, KeyedTable, KeyLog
from billgrid.streaming.events import admit_work, delta_to_messages, history_to_messages


def decide_words(words: DataFrame, owners: DataFrame, ap: DataFrame) -> DataFrame:
    """Words to decisions: extract, normalize, match, decide."""
    parsed = extract.finalize(extract.extract_invoices(words), words.select("doc_id"))
    inv = normalize.normalize_invoices(parsed.join(owners, "doc_id"))
    found = match.match_ap_context(match.match_keys(inv), ap)
    return decide.decide(match.hydrate_context(inv, found, ap))


def decisions_table(spark: SparkSession, out: str, like: DataFrame, buckets: int = BUCKETS) -> KeyedTable:
    """ST10: the stored decisions, one row for each document, with the batch that made it."""
    return KeyedTable(spark, out, like.withColumn("batch", F.lit(0).cast("long")).schema, ["doc_id"], buckets)


def run_stream(spark: SparkSession, words_path: str, ap: DataFrame, owners: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """ST10: decide every document of newly arrived word files and upsert the decisions.

    A document's words must arrive in one file set. A micro-batch reads and replaces only the
    partitions of ``out`` into which its documents fall; replayed, it puts the same ones in place.
    Intermediate tables go with the batch.
    """
    stream = spark.readStream.schema(schemas.WORD).parquet(words_path)

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with scratch(spark):
            made = decide_words(batch, owners, ap)
            decisions_table(spark, out, made, buckets).upsert_latest(made.withColumn("batch", F.lit(batch_id).cast("long")), "batch", batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_decisions(spark: SparkSession, out: str) -> DataFrame:
    """ST10: the newest decision of every document: the stored state itself, no history is read."""
    return spark.read.parquet(out).drop(BUCKET, "batch")


def admit_stream(stream: DataFrame, known_path: str, out: str, checkpoint: str, live: Callable[[], DataFrame] | None = None, buckets: int = BUCKETS, most_parts: int = 16) -> StreamingQuery:
    """ST2 as a sink: admitted keys live in a table (:class:`KeyLog`) of which a batch reads only the
    buckets of its own keys.

    State stays in the table instead of the operator, so it may grow without bound. ``live`` gives the
    keys (unique_key) active now; it is asked once a batch, so work that waits for its live twin
    enters with a later batch. :func:`billgrid.streaming.state.admit_by_state` keeps the same
    decisions as state of the stream.
    """
    spark = stream.sparkSession
    keys = KeyLog(spark, f"{known_path}/keys", buckets, most_parts)

    def one(batch: DataFrame, batch_id: int) -> None:
        known = keys.known(batch, batch_id)
        fresh = admit_work(batch, known, live() if live else known.limit(0))
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id:09d}")
        written = spark.read.parquet(f"{out}/batch={batch_id:09d}")
        keys.add(written, batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_history(spark: SparkSession, feed: str, out: str, checkpoint: str) -> StreamingQuery:
    """ST3 over a stored feed: fetch work and rescans of each micro-batch under ``out``.

    Cursors are the stream's offsets: a restart goes on where the checkpoint stands, accounts new to
    it and cursors unknown to the feed are rescanned. A replayed batch overwrites its own folders.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            pages = materialize(batch, "pages")
            work, cursors, rescans = history_to_messages(pages, known_cursors(pages))
            for name, rows in (("work", work), ("cursors", cursors), ("rescans", rescans)):
                rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")

    return read_feed(spark, feed).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_delta(spark: SparkSession, feed: str, out: str, checkpoint: str) -> StreamingQuery:
    """ST4 over a stored feed: fetch work of each micro-batch; as :func:`sync_history`."""

    def one(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            work, _ = delta_to_messages(materialize(batch, "pages"))
            work.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/work")

    return read_feed(spark, feed).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
