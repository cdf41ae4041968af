"""Queues and work lists over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.functions import keys as kx
from billgrid.functions import lexicon as lx
from billgrid.functions import text as tx
from billgrid.functions.money import amount_display
from billgrid.operators.candidates import first_per
from billgrid.operators.merge import second_pass_eligible


def for_owner(df: DataFrame, owner: str) -> DataFrame:
    """P5: rows of one tenant; prunes partitions where the table is partitioned by owner."""
    return df.filter(F.col("owner_user_id") == owner)


def needs_review(decision: Column) -> Column:
    """Undecided, or a decision a person has to act on."""
    return decision.isNull() | decision.isin(*lx.REVIEW_DECISIONS)


def received_between(df: DataFrame, column: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Inclusive date range; undated rows drop only when a bound is set."""
    day = F.to_date(F.col(column))
    if low is not None:
        df = df.filter(day >= F.lit(low).cast("date"))
    if high is not None:
        df = df.filter(day <= F.lit(high).cast("date"))
    return df


def count_invoices(extractions: DataFrame) -> DataFrame:
    """A1."""
    return extractions.groupBy("owner_user_id").agg(F.count("*").alias("invoice_count"))


def queue_rows(extractions: DataFrame, decisions: DataFrame, attachments: DataFrame, messages: DataFrame) -> DataFrame:
    """J1 without order: every extraction with its decision, attachment and message."""
    d = decisions.select("owner_user_id", "pdf_file_id", "decision", F.col("confidence").alias("decision_confidence"), "next_action")
    a = attachments.select(F.col("id").alias("attachment_id"), "filename", "message_id")
    m = messages.select(F.col("id").alias("message_id"), "received_at", "sender", "subject")
    return (
        extractions.join(d, ["owner_user_id", "pdf_file_id"], "left")
        .join(a, "attachment_id", "left").join(m, "message_id", "left")
        .select(
            "owner_user_id", "pdf_file_id", "attachment_id", F.col("vendor_name").alias("vendor"), "invoice_number", "purchase_order",
            "amount_due", "currency", "parse_status", "parser_method", F.col("confidence").cast("double").alias("parse_confidence"),
            "decision", "decision_confidence", "next_action", "received_at", "filename", "sender", "subject", "updated_at",
        )
    )


def queue_row(rows: DataFrame) -> DataFrame:
    """The seventeen columns of a queue row."""
    return rows.select(
        "pdf_file_id", "attachment_id", "vendor", "invoice_number", "purchase_order", F.col("amount_due").cast("string").alias("amount_due"),
        "currency", F.col("received_at").alias("received_date"), "parse_status", "parser_method", "parse_confidence", "decision",
        F.col("decision_confidence").alias("confidence"), "next_action", "filename", "sender", "subject",
    )


def page_rows(rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, ``limit`` rows from an offset. The limit is the feature: one screen."""
    if limit < 1 or offset < 0:
        raise ValueError("a page has at least one row and does not start before the first")
    recent = F.coalesce("received_at", "updated_at")
    return rows.orderBy(F.desc(recent), F.desc("updated_at"), F.desc("pdf_file_id")).offset(offset).limit(limit)


def list_invoices(extractions, decisions, attachments, messages, owner: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The whole queue, or one page of it. Filters come before the limit."""
    scoped = extractions if owner is None else for_owner(extractions, owner)
    rows = queue_rows(scoped, decisions, attachments, messages)
    return rows if limit is None else page_rows(rows, limit, offset)


def invoice_wide(extractions, files, parses, decisions, attachments, messages) -> DataFrame:
    """Every stored fact about every invoice; the file must exist, the rest may be absent."""
    f = files.select(F.col("id").alias("pdf_file_id"), "sha256", "byte_size", "storage_path")
    p = parses.select(
        "pdf_file_id", F.col("status").alias("raw_parse_status"), F.col("parser_version").alias("raw_parser_version"),
        F.col("result").alias("raw_parse_result"), F.col("warnings").alias("raw_parse_warnings"), F.col("updated_at").alias("parsed_at"),
    )
    d = decisions.select(
        "owner_user_id", "pdf_file_id", "decision", F.col("confidence").alias("decision_confidence"),
        F.col("summary").alias("decision_summary"), F.col("next_action").alias("decision_next_action"),
    )
    a = attachments.select(F.col("id").alias("attachment_id"), "account_id", "message_id", "filename", "mime_type", "candidate_reason")
    m = messages.select(F.col("id").alias("message_id"), "provider", "provider_message_id", "sender", "subject", "received_at")
    return (
        extractions.join(f, "pdf_file_id").join(p, "pdf_file_id", "left").join(d, ["owner_user_id", "pdf_file_id"], "left")
        .join(a, "attachment_id", "left").join(m, "message_id", "left")
    )


def invoice_detail(wide: DataFrame) -> DataFrame:
    """Nested message, attachment, file and decision."""
    return wide.select(
        "pdf_file_id", "owner_user_id",
        F.struct("provider", "provider_message_id", "sender", "subject", "received_at").alias("message"),
        F.struct(F.col("attachment_id").alias("id"), "filename", "mime_type", "candidate_reason").alias("attachment"),
        F.struct("sha256", "byte_size").alias("pdf"),
        F.struct(
            F.coalesce("raw_parse_status", "parse_status").alias("status"), F.col("raw_parser_version").alias("parser_version"), "parser_method",
            F.array_sort(F.json_object_keys(F.get_json_object("raw_parse_result", "$.fields"))).alias("field_keys"),
            kx.json_arr(F.col("raw_parse_warnings")).alias("warnings"),
        ).alias("raw_parse"),
        F.when(F.col("decision").isNotNull(), F.struct(
            "decision", F.col("decision_confidence").alias("confidence"), F.col("decision_summary").alias("summary"),
            F.col("decision_next_action").alias("next_action"),
        )).alias("decision"),
    )


def review_queue(extractions, files, parses, decisions, attachments, messages, accounts, owner: str | None = None) -> DataFrame:
    """Invoices that wait for a person, with everything the screen shows."""
    scoped = extractions if owner is None else for_owner(extractions, owner)
    acc = accounts.select(F.col("id").alias("account_id"), F.col("email").alias("account_email"))
    return invoice_wide(scoped, files, parses, decisions, attachments, messages).join(acc, "account_id", "left").filter(
        needs_review(F.col("decision"))
    )


def review_page(rows: DataFrame, n: int = 50) -> DataFrame:
    """The newest rows of a review queue."""
    return rows.orderBy(F.desc(F.coalesce("received_at", "updated_at")), F.desc("updated_at"), F.desc("pdf_file_id")).limit(n)


def review_item(rows: DataFrame) -> DataFrame:
    """Display values: the stored column, else the value inside the parse, else the file name."""
    blank = tx.null_if_empty
    dig = lambda path: F.get_json_object("raw_parse_result", path)
    name = F.coalesce("filename", F.lit(""))
    return rows.select(
        "attachment_id", "pdf_file_id", name.alias("filename"),
        F.coalesce(blank(F.col("invoice_number")), blank(F.trim(dig("$.fields.invoice_number.value"))), name).alias("invoice_number"),
        F.coalesce(blank(F.col("vendor_name")), tx.first_party_line(dig("$.fields.seller.raw"))).alias("vendor"),
        F.coalesce(
            amount_display(F.col("amount_due"), F.col("currency")),
            amount_display(dig("$.fields.balance_due.amount"), dig("$.fields.balance_due.currency")),
        ).alias("amount"),
        "subject", "sender", "received_at", "provider", "account_email", "candidate_reason",
        F.coalesce(blank(F.col("parse_status")), F.lit("pending")).alias("parse_status"), "parsed_at",
        kx.json_arr(F.col("raw_parse_warnings")).alias("warnings"), "decision", F.col("decision_confidence").alias("confidence"),
        F.col("decision_next_action").alias("next_action"),
    )


def latest_attachment(files, attachments, accounts) -> DataFrame:
    """Per owner and file the newest attachment."""
    acc = accounts.select(F.col("id").alias("account_id"), "owner_user_id")
    f = files.select(F.col("id").alias("pdf_file_id"), "sha256", "byte_size", "storage_path")
    rows = attachments.select(F.col("id").alias("attachment_id"), "account_id", "pdf_file_id", "filename", "created_at").join(acc, "account_id").join(f, "pdf_file_id")
    return first_per(rows, ["owner_user_id", "pdf_file_id"], [F.desc("created_at"), F.desc("attachment_id")])


def _owned_attachments(attachments, accounts, files) -> DataFrame:
    acc = accounts.select(F.col("id").alias("account_id"), "owner_user_id")
    f = files.select(F.col("id").alias("pdf_file_id"), "storage_path")
    return attachments.select(F.col("id").alias("attachment_id"), "account_id", "pdf_file_id", "created_at").join(acc, "account_id").join(f, "pdf_file_id")


def _live_parse_work(jobs: DataFrame) -> DataFrame:
    """Files with parse work waiting, running or to be retried."""
    return jobs.filter((F.col("type") == "parse_pdf") & F.col("status").isin("pending", "running", "retry")).select(
        F.get_json_object("payload", "$.pdf_file_id").try_cast("long").alias("pdf_file_id")
    ).filter("pdf_file_id is not null").distinct()


def stale_parses(attachments, accounts, files, parses, jobs, revision: str, limit: int | None = None) -> DataFrame:
    """Attachments whose file was last parsed under another revision and has no live work.

    Output is the work to add: one row per attachment. ``limit`` sizes one sweep.
    """
    last = parses.select("pdf_file_id", "parser_version")
    rows = (
        _owned_attachments(attachments, accounts, files).join(last, "pdf_file_id", "left")
        .filter(~F.col("parser_version").eqNullSafe(F.lit(revision)))
        .join(_live_parse_work(jobs), "pdf_file_id", "left_anti")
    )
    rows = first_per(rows, ["attachment_id"], ["created_at", "pdf_file_id"]).withColumn(
        "unique_key", kx.parse_work_key(F.col("attachment_id"), F.lit(revision))
    )
    return rows if limit is None else rows.orderBy("attachment_id").limit(limit)


def second_pass_candidates(attachments, accounts, files, parses, jobs, replay_key: str, owner: str | None = None, limit: int | None = None) -> DataFrame:
    """Reviewed files a second pass may help, one row per file."""
    p = parses.filter(
        second_pass_eligible(
            F.col("status"), F.get_json_object("result", "$.ocr_used") == "true",
            F.from_json(F.get_json_object("result", "$.ocr_failed_parts"), "array<string>"),
            F.from_json(F.get_json_object("result", "$.warnings"), "array<string>"),
        )
    ).select("pdf_file_id")
    acc = accounts if owner is None else for_owner(accounts, owner)
    rows = _owned_attachments(attachments, acc, files).join(p, "pdf_file_id", "left_semi").join(_live_parse_work(jobs), "pdf_file_id", "left_anti")
    rows = first_per(rows, ["pdf_file_id"], ["created_at", "attachment_id"]).withColumn(
        "unique_key", F.concat(F.lit("parse-pdf-ai:"), F.col("attachment_id").cast("string"), F.lit(":" + replay_key))
    )
    return rows if limit is None else rows.orderBy("pdf_file_id").limit(limit)
