"""Mail messages to parse work (S4, P8-P14, F33, F34, ST6, ST11)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid.functions import dates as dx
from billgrid.functions import keys as kx
from billgrid.functions import lexicon as lx
from billgrid.functions.text import text_or_empty
from billgrid.session import work_dir

NONE = "cast(array() as array<string>)"


def is_pdf_attachment(mime: Column, name: Column) -> Column:
    """P11."""
    return (F.lower(text_or_empty(mime)) == "application/pdf") | F.lower(text_or_empty(name)).endswith(".pdf")


def is_invoice_candidate(values: list[Column], patterns: Column) -> Column:
    """Any pattern found in any of the texts, whatever the case."""
    texts = F.filter(F.array(*values), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(
        F.exists(patterns, lambda p: F.exists(texts, lambda v: F.rlike(v, F.concat(F.lit("(?i)"), p)))), F.lit(False)
    )


def filter_candidates(att: DataFrame, settings: DataFrame, columns=("filename", "subject", "body", "snippet")) -> DataFrame:
    """P9 + P10: drop attachments their owner's patterns exclude; label the rest.

    Owners without settings have no patterns and keep everything. Invalid patterns do not take part:
    see :func:`bad_patterns`.
    """
    with_p = att.join(usable_patterns(settings.select("owner_user_id", "patterns")), "owner_user_id", "left").withColumn(
        "patterns", F.coalesce("patterns", F.expr(NONE))
    )
    hit = is_invoice_candidate([F.col(c) for c in columns if c in att.columns], F.col("patterns"))
    return (
        with_p.withColumn("_hit", hit)
        .filter((F.size("patterns") == 0) | F.col("_hit"))
        .withColumn("candidate_reason", candidate_reason(F.col("_hit")))
        .drop("_hit", "patterns")
    )


def candidate_reason(hit: Column) -> Column:
    """P10."""
    return F.when(hit, "invoice_hint").otherwise("pdf_attachment")


def decode_base64(c: Column, url_safe: bool) -> Column:
    """Bytes of base64 text, NULL when it is malformed."""
    text = F.translate(c, "-_", "+/") if url_safe else c
    if url_safe:
        text = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    return F.try_to_binary(text, F.lit("base64"))


def valid_pdf(encoded: Column, declared: Column, url_safe: bool, limit: int = lx.MAX_ATTACHMENT_BYTES) -> Column:
    """The decoded file when every guard passes, else NULL; :func:`pdf_rejection` tells why.

    Sizes are tested before decoding, so oversized text is never decoded.
    """
    small = ~F.coalesce(declared.try_cast("long") > limit, F.lit(False)) & (F.length(encoded) <= ((limit + 2) // 3) * 4)
    content = F.when(small, decode_base64(encoded, url_safe))
    return F.when((F.octet_length(content) <= limit) & (F.hex(F.substring(content, 1, 5)) == "255044462D"), content)


def pdf_rejection(encoded: Column, declared: Column, url_safe: bool, limit: int = lx.MAX_ATTACHMENT_BYTES) -> Column:
    """Why :func:`valid_pdf` gives no file: absent, oversized, malformed or no PDF; else NULL."""
    large = F.coalesce(declared.try_cast("long") > limit, F.lit(False)) | (F.length(encoded) > ((limit + 2) // 3) * 4)
    content = F.when(~large, decode_base64(encoded, url_safe))
    return (
        F.when(encoded.isNull(), "absent").when(large | (F.octet_length(content) > limit), "oversized")
        .when(content.isNull(), "malformed").when(F.hex(F.substring(content, 1, 5)) != "255044462D", "not_a_pdf")
    )


def engine_pattern(p: Column) -> Column:
    """A pattern as the engine that applies it writes it: named groups become plain ones (their numbers
    stay), and the end of the text is the very end."""
    p = F.regexp_replace(p, r"((?<!\\)(?:\\\\)*)\(\?P<[A-Za-z_]\w*>", "$1(")
    return F.regexp_replace(p, r"((?<!\\)(?:\\\\)*)\\Z", r"$1\\z")


def _compiles(p: Column) -> Column:
    """Whether the engine that applies patterns, ignoring case, takes this one."""
    return F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?i)"), engine_pattern(p))).isNotNull()


def usable_patterns(settings: DataFrame) -> DataFrame:
    """Settings with the patterns that the matching engine takes, in its own writing, so that one
    owner's mistake does not fail everybody's work. Tested once per owner, not per message."""
    return settings.withColumn("patterns", F.transform(F.filter("patterns", _compiles), engine_pattern))


def bad_patterns(settings: DataFrame) -> DataFrame:
    """owner_user_id, pattern, reason of the patterns that :func:`usable_patterns` leaves out."""
    bad = F.filter(F.array_compact("patterns"), lambda p: ~_compiles(p))
    return settings.select("owner_user_id", F.explode(bad).alias("pattern"), F.lit("invalid expression").alias("reason"))


def provider_attachments(att: DataFrame) -> DataFrame:
    """Attached files only, nothing inline."""
    kind = F.coalesce("odata_type", F.lit(""))
    return att.filter(kind.isin("", "#microsoft.graph.fileAttachment") & ~F.coalesce("is_inline", F.lit(False)))


def mime_parts(messages: DataFrame, payload: str = "payload", depth: int | None = None) -> DataFrame:
    """All MIME parts of nested JSON payloads, depth first: path, mime, filename, body.

    Without ``depth`` the levels are exploded one after the other until one has no parts; each is
    written to the shared folder and read once by the next, so the work follows the parts there are
    and the plan is the same for any nesting. A stream must give ``depth``, which makes one plan of so
    many levels; deeper payloads then fail instead of losing parts.
    """
    if depth is None:
        return _part_fields(_parts_by_level(messages, payload))
    level = messages.select("message_id", F.expr(NONE).alias("path"), F.col(payload).alias("part"))
    out = None
    for step in range(depth):
        here = level.filter("part is not null").select("message_id", "path", "part")
        out = here if out is None else out.unionByName(here)
        kids = F.from_json(F.get_json_object("part", "$.parts"), "array<string>")
        if step == depth - 1:
            cut = F.when(F.size(kids) > 0, F.raise_error(F.lit("parts below the given depth")).cast("string"))
            out = out.withColumn("part", F.coalesce(F.when(F.size("path") == step, cut), F.col("part")))
        # objects inside the array come back as their JSON text
        level = _children(here)
    return _part_fields(out)


def _children(parts: DataFrame) -> DataFrame:
    """The parts one level below, as their JSON text."""
    kids = F.from_json(F.get_json_object("part", "$.parts"), "array<string>")
    return parts.select("message_id", "path", F.posexplode(kids).alias("i", "child")).select(
        "message_id", F.concat("path", F.array(F.format_string("%04d", "i"))).alias("path"), F.col("child").alias("part")
    )


def _parts_by_level(messages: DataFrame, payload: str) -> DataFrame:
    spark = messages.sparkSession
    at = f"{work_dir(spark)}/mime-parts-{uuid.uuid4().hex}"
    level, depth = messages.select("message_id", F.expr(NONE).alias("path"), F.col(payload).alias("part")), 0
    schema = level.schema
    while True:
        level.filter("part is not null").write.parquet(f"{at}/level={depth}")
        level = spark.read.schema(schema).parquet(f"{at}/level={depth}")
        if level.isEmpty():
            return spark.read.schema(schema).parquet(at)
        level, depth = _children(level), depth + 1


def _part_fields(parts: DataFrame) -> DataFrame:
    g = lambda p: F.get_json_object("part", p)
    return parts.select(
        "message_id", F.array_join("path", ".").alias("path"), g("$.mimeType").alias("mime_type"), g("$.filename").alias("filename"),
        g("$.body.attachmentId").alias("attachment_id"), g("$.body.data").alias("data"), g("$.body.size").alias("size"),
    )


def pdf_parts(parts: DataFrame) -> DataFrame:
    return parts.filter(is_pdf_attachment(F.col("mime_type"), F.col("filename")))


def body_text(parts: DataFrame) -> DataFrame:
    """Decoded text parts of each message, joined in document order."""
    text = F.decode(decode_base64(F.col("data"), True), "utf-8")
    keep = (F.coalesce("filename", F.lit("")) == "") & F.lower("mime_type").startswith("text/") & F.col("data").isNotNull()
    return (
        parts.filter(keep).select("message_id", "path", text.alias("t")).filter("t is not null")
        .groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("path", "t"))).alias("p"))
        .select("message_id", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("body"))
    )


GMAIL = (
    "account_id long, owner_user_id string, id string, threadId string, internalDate string, snippet string, "
    "payload string"
)
OUTLOOK = (
    "account_id long, owner_user_id string, id string, conversationId string, subject string, sender string, "
    "bodyPreview string, receivedDateTime string, hasAttachments boolean, attachments array<struct<id:string,name:string,"
    "contentType:string,size:string,isInline:boolean,odata_type:string,contentBytes:string>>"
)


def read_mail_events(spark: SparkSession, path: str, provider: str, streaming: bool = False) -> DataFrame:
    """Stored provider payloads (one JSON per line), as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(GMAIL if provider == "gmail" else OUTLOOK).json(path)


def gmail_messages(raw: DataFrame) -> DataFrame:
    """Message rows of the first provider shape, without bodies."""
    headers = F.from_json(F.get_json_object("payload", "$.headers"), "array<struct<name:string,value:string>>")
    return raw.withColumn("_h", headers).select(
        "account_id", "owner_user_id", F.lit("gmail").alias("provider"), F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"),
        F.lit(None).cast("string").alias("conversation_id"), kx.header_value(F.col("_h"), "from").alias("sender"),
        kx.header_value(F.col("_h"), "subject").alias("subject"),
        dx.received_at(F.col("internalDate"), kx.header_value(F.col("_h"), "date")).alias("received_at"), "snippet", "payload",
    )


def gmail_attachments(messages: DataFrame) -> DataFrame:
    parts = mime_parts(messages)
    pdfs = pdf_parts(parts).select(
        "message_id", F.col("attachment_id").alias("provider_attachment_id"),
        F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.concat("message_id", F.lit(".pdf"))).alias("filename"), "mime_type",
        F.col("size").alias("declared_size"), F.col("data").alias("encoded"),
    )
    return messages.drop("payload").join(pdfs, "message_id").join(body_text(parts), "message_id", "left").withColumn("url_safe", F.lit(True))


def outlook_attachments(raw: DataFrame) -> DataFrame:
    rows = raw.filter("hasAttachments").select(
        "account_id", "owner_user_id", F.lit("outlook").alias("provider"), F.col("id").alias("message_id"), F.lit(None).cast("string").alias("thread_id"),
        F.col("conversationId").alias("conversation_id"), "sender", "subject", dx.rfc3339(F.col("receivedDateTime")).alias("received_at"),
        F.lit(None).cast("string").alias("snippet"), F.col("bodyPreview").alias("body"), F.explode("attachments").alias("a"),
    ).select(
        "*", F.col("a.odata_type").alias("odata_type"), F.col("a.isInline").alias("is_inline"), F.col("a.id").alias("provider_attachment_id"),
        F.coalesce(F.nullif(F.col("a.name"), F.lit("")), F.concat("message_id", F.lit(".pdf"))).alias("filename"),
        F.col("a.contentType").alias("mime_type"), F.col("a.size").alias("declared_size"), F.col("a.contentBytes").alias("encoded"),
    ).drop("a")
    return provider_attachments(rows).filter(is_pdf_attachment(F.col("mime_type"), F.col("filename"))).drop("odata_type", "is_inline").withColumn(
        "url_safe", F.lit(False)
    )


def messages_to_work(gmail: DataFrame, outlook: DataFrame, settings: DataFrame, version: str = lx.PARSER_VERSION) -> DataFrame:
    """ST6: attachments worth parsing, content-addressed, with their parse work key."""
    att = gmail_attachments(gmail_messages(gmail)).unionByName(outlook_attachments(outlook), allowMissingColumns=True)
    kept = filter_candidates(att, settings)
    content = F.when(F.col("url_safe"), valid_pdf(F.col("encoded"), F.col("declared_size"), True)).otherwise(
        valid_pdf(F.col("encoded"), F.col("declared_size"), False)
    )
    rows = kept.withColumn("content", content).filter("content is not null").withColumn("sha256", F.sha2("content", 256))
    key = F.when(F.col("url_safe"), kx.attachment_key(F.col("provider_attachment_id"), F.col("filename"), F.col("sha256"), "inline")).otherwise(
        kx.attachment_key(F.col("provider_attachment_id"), F.col("filename"), F.col("sha256"), "file")
    )
    rows = rows.withColumn("attachment_key", key)
    return rows.select(
        "account_id", "owner_user_id", "provider", "message_id", "thread_id", "conversation_id", "sender", "subject", "received_at",
        "attachment_key", "filename", "mime_type", "candidate_reason", "sha256", F.octet_length("content").alias("byte_size"),
        F.concat("sha256", F.lit(".pdf")).alias("storage_path"),
        kx.parse_work_key(F.concat_ws(":", "provider", F.col("account_id").cast("string"), "message_id", "attachment_key"), F.lit(version)).alias("unique_key"),
    )


def rescan_to_messages(pages: DataFrame, replay: str | None = None) -> DataFrame:
    """ST11 + ST7: fetch work for every message a full mailbox scan lists.

    ``pages``: account_id, message_ids array. A replay key passes dedupe on purpose.
    """
    rows = pages.select("account_id", F.explode("message_ids").alias("message_id")).filter("message_id is not null").distinct()
    key = kx.message_work_key(F.lit("gmail"), F.col("account_id"), F.col("message_id"), F.lit(replay).cast("string"))
    return rows.select(F.lit("gmail_message_fetch").alias("type"), "account_id", "message_id", key.alias("unique_key"))
