"""Composed keys (F30), header lookup (F34) and JSON access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrid.functions.text import null_if_empty, text_or_empty


def source_key(origin: Column, document: Column) -> Column:
    return F.concat_ws(":", F.lit("manifest"), null_if_empty(origin), null_if_empty(document))


def message_work_key(provider: Column, account: Column, message_id: Column, replay: Column | None = None) -> Column:
    """Unique key of a message fetch; a replay key makes it distinct so dedupe lets it pass."""
    base = F.concat(provider, F.lit("-message:"), account.cast("string"), F.lit(":"), message_id)
    if replay is None:
        return base
    return F.when(
        F.coalesce(replay, F.lit("")) != "", F.concat(base, F.lit(":reprocess:"), replay)
    ).otherwise(base)


def parse_work_key(attachment_id: Column, version: Column) -> Column:
    return F.concat(F.lit("parse-pdf:"), attachment_id.cast("string"), F.lit(":"), version)


def push_event_key(message_id: Column, email: Column, history_id: Column) -> Column:
    return F.coalesce(
        null_if_empty(message_id.cast("string")),
        F.concat(F.coalesce(email, F.lit("None")), F.lit(":"), F.coalesce(history_id.cast("string"), F.lit("None"))),
    )


def subscription_event_key(subscription: Column, change: Column, message_id: Column, expires: Column) -> Column:
    return F.concat(
        subscription, F.lit(":"), F.coalesce(null_if_empty(change), F.lit("created")), F.lit(":"),
        message_id, F.lit(":"), text_or_empty(expires),
    )


def attachment_key(provider_id: Column, filename: Column, sha256: Column, prefix: str = "inline") -> Column:
    return F.coalesce(
        null_if_empty(provider_id), F.concat(F.lit(prefix + ":"), filename, F.lit(":"), sha256)
    )


def message_id_from_resource(resource: Column) -> Column:
    """Text behind the last ``/messages/`` of a resource path, without quotes."""
    tail = F.substring_index(resource, "/messages/", -1)
    return F.when(resource.contains("/messages/"), F.regexp_replace(tail, "^'+|'+$", ""))


def header_value(headers: Column, name: str) -> Column:
    hit = F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), 0)
    return hit["value"]


def json_obj(c: Column) -> Column:
    """The text when it holds a JSON object, else ``{}``."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)).otherwise(F.lit("{}"))


def json_arr(c: Column) -> Column:
    """The text when it holds a JSON array, else ``[]``."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.to_json(v)).otherwise(F.lit("[]"))
