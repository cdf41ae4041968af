"""Notifications and work, as streams or batches (ST1-ST5, ST7, ST12, U2, J12, J13, A25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.functions import keys as kx
from billgrid.functions import lexicon as lx
from billgrid.operators.mail import decode_base64

NONE = "cast(array() as array<string>)"


def dedupe_events(stream: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """ST1: first event per (provider, account, key); unknown accounts share one slot.

    Keys are kept forever unless a ``(column, delay)`` watermark bounds the state.
    """
    df = stream.withColumn("_account", F.coalesce(F.col("account_id").cast("long"), F.lit(-1)))
    keys = ["provider", "_account", "event_key"]
    if watermark is None:
        return df.dropDuplicates(keys).drop("_account")
    column, delay = watermark
    return df.withWatermark(column, delay).dropDuplicatesWithinWatermark(keys).drop("_account")


def first_events(events: DataFrame) -> DataFrame:
    """ST1 over a stored table: the lowest id of each key survives."""
    cols = [c for c in events.columns if c not in ("provider", "account_id", "event_key")]
    return events.groupBy("provider", "account_id", "event_key").agg(F.min_by(F.struct(*cols), "id").alias("v")).select(
        "provider", "account_id", "event_key", "v.*"
    )


def dedupe_unknown_events(events: DataFrame) -> DataFrame:
    """Of events without an account keep the lowest id per key; the others are untouched."""
    unknown = events.filter("account_id is null")
    cols = [c for c in events.columns if c not in ("provider", "event_key")]
    kept = unknown.groupBy("provider", "event_key").agg(F.min_by(F.struct(*cols), "id").alias("v")).select("provider", "event_key", "v.*")
    return events.filter("account_id is not null").unionByName(kept.select(*events.columns))


def admit_work(work: DataFrame, known: DataFrame, live: DataFrame) -> DataFrame:
    """ST2: work that may enter. Durable types never return once seen, others wait only for
    their live twin to finish. ``known``: unique_key seen; ``live``: unique_key active now."""
    first = work.groupBy("unique_key").agg(F.min_by(F.struct(*[c for c in work.columns if c != "unique_key"]), "seq").alias("v")).select("unique_key", "v.*")
    durable = F.col("type").isin(*lx.DURABLE_WORK_TYPES)
    fresh = first.filter(durable).join(known.select("unique_key"), "unique_key", "left_anti").unionByName(first.filter(~durable))
    return fresh.join(live.select("unique_key"), "unique_key", "left_anti").select(*work.columns)


def history_to_messages(pages: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ST3: (fetch work, new cursors, rescans) from history pages.

    ``pages``: account_id, page_no, added array, touched array, history_id, not_found boolean.
    Accounts without a cursor, or whose cursor the provider no longer knows, get a rescan.
    """
    cursor = accounts.select("account_id", "cursor")
    gone = pages.groupBy("account_id").agg(F.bool_or(F.coalesce("not_found", F.lit(False))).alias("_gone"))
    state = pages.select("account_id").distinct().join(cursor, "account_id", "left").join(gone, "account_id")
    rescans = state.filter(F.col("cursor").isNull() | F.col("_gone")).select(
        "account_id",
        F.when(F.col("cursor").isNull(), F.format_string("gmail-fallback:%d:missing-history", "account_id"))
        .otherwise(F.format_string("gmail-fallback:%d:stale:%s", "account_id", "cursor")).alias("unique_key"),
    )
    usable = state.filter(F.col("cursor").isNotNull() & ~F.col("_gone")).select("account_id")
    ids = F.concat(F.coalesce("added", F.expr(NONE)), F.coalesce("touched", F.expr(NONE)))
    live = pages.join(usable, "account_id", "left_semi")
    work = live.select("account_id", F.explode(ids).alias("message_id")).filter("message_id is not null").distinct().withColumn(
        "unique_key", kx.message_work_key(F.lit("gmail"), F.col("account_id"), F.col("message_id"))
    )
    moved = pages.join(state.filter(~F.col("_gone")).select("account_id"), "account_id", "left_semi")
    cursors = moved.filter("history_id is not null").groupBy("account_id").agg(F.max_by("history_id", "page_no").alias("cursor"))
    return work, cursors, rescans


def delta_to_messages(pages: DataFrame, replay: str | None = None) -> tuple[DataFrame, DataFrame]:
    """ST4: (fetch work, new cursors) from delta pages: removed messages and those without
    attachments are skipped; a replay never moves the cursor.

    ``pages``: account_id, page_no, messages array<struct<id, removed, has_attachments>>, delta_link.
    """
    rows = pages.select("account_id", F.explode("messages").alias("m")).filter(
        ~F.coalesce("m.removed", F.lit(False)) & F.coalesce("m.has_attachments", F.lit(False)) & F.col("m.id").isNotNull()
    ).select("account_id", F.col("m.id").alias("message_id")).distinct()
    key = kx.message_work_key(F.lit("outlook"), F.col("account_id"), F.col("message_id"), F.lit(replay).cast("string"))
    cursors = pages.filter("delta_link is not null").groupBy("account_id").agg(F.max_by("delta_link", "page_no").alias("cursor"))
    return rows.withColumn("unique_key", key), cursors.filter(F.lit(replay is None))


def decode_notifications(df: DataFrame, data: str = "data", message_id: str = "message_id") -> DataFrame:
    """ST5: base64url JSON notification to email, history id and event key."""
    j = F.decode(decode_base64(F.col(data), True), "utf-8")
    email, history = F.get_json_object(j, "$.emailAddress"), F.get_json_object(j, "$.historyId")
    return df.withColumn("email", email).withColumn("history_id", history).withColumn(
        "event_key", kx.push_event_key(F.col(message_id), F.col("email"), F.col("history_id"))
    )


def route_by_email(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every account of the address, any case; unknown addresses keep a NULL account."""
    acc = accounts.select(F.col("id").alias("account_id"), F.lower("email").alias("_e"), F.col("status").alias("account_status"))
    return events.withColumn("_e", F.lower("email")).join(acc, "_e", "left").drop("_e")


def route_by_subscription(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Account of a subscription; ``rejected`` names the first failed test."""
    acc = accounts.select(
        F.col("subscription_id").alias("_sub"), F.col("id").alias("account_id"), F.col("status").alias("_status"), F.col("client_state").alias("_state")
    )
    mid = F.coalesce(F.nullif(F.col("message_id"), F.lit("")), kx.message_id_from_resource(F.col("resource")))
    joined = events.withColumn("message_id", mid).join(acc, events["subscription_id"] == F.col("_sub"), "left")
    rejected = (
        F.when(F.col("subscription_id").isNull(), "no_subscription")
        .when(F.col("account_id").isNull() | ~F.col("_status").eqNullSafe(F.lit("active")), "unknown_or_inactive_account")
        .when(~F.col("client_state").eqNullSafe(F.col("_state")), "client_state_mismatch")
        .when(F.coalesce("message_id", F.lit("")) == "", "no_message")
    )
    return joined.withColumn("rejected", rejected).withColumn(
        "event_key",
        F.when(rejected.isNull(), kx.subscription_event_key(F.col("subscription_id"), F.col("change_type"), F.col("message_id"), F.col("expires"))),
    ).drop("_sub", "_status", "_state")


def notification_outcomes(routed: DataFrame) -> DataFrame:
    """Accepted, duplicate or rejected, per notification of one batch."""
    dup_key = ["account_id", "event_key"]
    routable = routed.filter("rejected is null")
    firsts = routable.groupBy(*dup_key).agg(F.min("id").alias("_first"))
    met = routable.join(firsts, dup_key, "left").withColumn("outcome", F.when(F.col("id") == F.col("_first"), "accepted").otherwise("duplicate"))
    # rejected rows have no key: joined, all of them would meet in one task
    return met.drop("_first").unionByName(routed.filter("rejected is not null").withColumn("outcome", F.lit("rejected")))


def notification_counts(outcomes: DataFrame) -> DataFrame:
    """A25."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def replay_keys(work: DataFrame, key: str) -> DataFrame:
    """ST7: the same work under a replay key, so that dedupe lets it through once more."""
    return work.withColumn("unique_key", kx.message_work_key(F.col("provider"), F.col("account_id"), F.col("message_id"), F.lit(key)))


def resolve_owner(work: DataFrame, accounts: DataFrame) -> DataFrame:
    """ST12: owner named in the work, else its account's, else none."""
    acc = accounts.select(F.col("id").alias("account_id"), F.col("owner_user_id").alias("_owner"))
    own = F.coalesce(F.nullif(F.col("owner_user_id"), F.lit("")), F.nullif(F.col("_owner"), F.lit("")))
    return work.join(acc, "account_id", "left").withColumn("owner_user_id", own).drop("_owner")
