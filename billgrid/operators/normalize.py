"""Canonical invoices from extracted fields (N1, N2, P18, A9), one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.functions import lexicon as lx
from billgrid.functions import text as tx

EVIDENCE = "struct<source_field:string,page:int,bbox:array<double>,raw:string,label:string,confidence:double,method:string>"
NO_TEXT = "cast(array() as array<string>)"


def evidence(source_field: str, f: Column) -> Column:
    """A struct of EVIDENCE's types: casting the parts costs nothing where they have them, casting the whole copies it."""
    types = {"page": "int", "bbox": "array<double>", "raw": "string", "label": "string", "confidence": "double", "method": "string"}
    return F.when(f.isNotNull(), F.struct(F.lit(source_field).alias("source_field"), *[f[k].cast(t).alias(k) for k, t in types.items()]))


def _raw(f: Column) -> Column:
    return tx.null_if_empty(tx.strip_ws(F.coalesce(tx.null_if_empty(f["value"]), f["raw"])))


def party(kind: str, f: Column, raw: Column) -> Column:
    """Name, identifiers and evidence of a seller or buyer block, whose text is ``raw``."""
    name = F.coalesce(tx.first_party_line(raw), raw)
    ids = tx.extract_vendor_ids(raw) if kind == "vendor" else F.expr(NO_TEXT)
    return F.when(
        raw.isNotNull(),
        F.struct(
            name.alias("name"), raw.alias("raw"), tx.normalize_vendor_name(name).alias("normalized_name"),
            tx.extract_tax_ids(raw).alias("tax_ids"), ids.alias("vendor_ids"), evidence(kind, f).alias("evidence"),
        ),
    )


def _value(f: Column) -> Column:
    return tx.null_if_empty(tx.strip_ws(tx.text_or_empty(f["value"])))


def text_field(key: str, f: Column, value: Column) -> Column:
    norm = {
        "invoice_number": tx.normalize_invoice_number, "purchase_order": tx.normalize_purchase_order,
    }.get(key, lambda c: F.lit(None).cast("string"))(value)
    return F.when(
        value.isNotNull(),
        F.struct(value.alias("value"), f["raw"].alias("raw"), norm.alias("normalized"), evidence(key, f).alias("evidence")),
    )


def _amount(f: Column) -> Column:
    return F.coalesce(f["amount"].try_cast("decimal(12,2)"), f["value"].try_cast("decimal(12,2)"))


def money_field(key: str, f: Column, amount: Column | None = None) -> Column:
    amount = _amount(f) if amount is None else amount
    return F.when(
        amount.isNotNull(),
        F.struct(amount.alias("amount"), f["currency"].alias("currency"), f["raw"].alias("raw"), evidence(key, f).alias("evidence")),
    )


def payment_details(f: Column, raw: Column) -> Column:
    return F.when(
        raw.isNotNull(),
        F.struct(
            raw.alias("raw"), tx.extract_bank_account(raw).alias("bank_account"),
            tx.extract_email(raw).alias("remit_to"), evidence("payment_instructions", f).alias("evidence"),
        ),
    )


def normalize_invoices(parsed: DataFrame) -> DataFrame:
    """Canonical row of every parsed document (the output of ``extract.finalize``)."""
    col = F.col
    texts = ("invoice_number", "issue_date", "due_date", "purchase_order", "terms", "currency")
    # every text is trimmed and every amount read once, for all that is derived from it
    read = {f"_{k}": _raw(col(k)) for k in ("seller", "buyer", "payment_instructions")}
    read |= {f"_{k}": _value(col(k)) for k in texts} | {f"_{k}": _amount(col(k)) for k in lx.MONEY_KEYS}
    base = parsed.withColumns(read).select(
        "doc_id",
        *[c for c in ("owner",) if c in parsed.columns],
        F.coalesce("status", F.lit("unknown")).alias("parser_status"),
        "parser_version",
        (col("status") == "no_text_layer").alias("no_text_layer"),
        party("vendor", col("seller"), col("_seller")).alias("vendor"),
        party("buyer", col("buyer"), col("_buyer")).alias("buyer"),
        *[text_field(k, col(k), col(f"_{k}")).alias(k) for k in texts],
        F.map_filter(
            F.map_from_arrays(
                F.array(*[F.lit(k) for k in lx.MONEY_KEYS]), F.array(*[money_field(k, col(k), col(f"_{k}")) for k in lx.MONEY_KEYS])
            ),
            lambda k, v: v.isNotNull(),
        ).alias("amounts"),
        payment_details(col("payment_instructions"), col("_payment_instructions")).alias("bank_details"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("item_amounts", F.lit(0)).alias("item_amounts"),
        col("item_total").try_cast("decimal(14,2)").alias("item_total"),
        F.coalesce("item_negative", F.lit(False)).alias("item_negative"),
        F.coalesce("item_currencies", F.expr(NO_TEXT)).alias("item_currencies"),
        F.coalesce("warnings", F.expr(NO_TEXT)).alias("parse_warnings"),
        *[c for c in ("page_count",) if c in parsed.columns],
    ).withColumn("amount_due", F.try_element_at("amounts", F.lit("balance_due")))
    return with_confidence(with_gaps(base))


def field_scores() -> Column:
    """Confidence per normalized field, for the fields that exist."""
    parts = {
        "vendor": "vendor", "buyer": "buyer", "invoice_number": "invoice_number", "issue_date": "issue_date",
        "due_date": "due_date", "purchase_order": "purchase_order", "terms": "terms", "currency": "currency",
        "amount_due": "amount_due", "payment_instructions": "bank_details",
    }
    own = [F.struct(F.lit(k).alias("key"), F.col(f"{c}.evidence.confidence").alias("value")) for k, c in parts.items()]
    sure = F.map_from_entries(F.filter(F.array(*own), lambda e: e["value"].isNotNull()))
    # the amounts are named once: they are long, and each name is a copy
    money = F.transform_values(F.map_filter("amounts", lambda k, v: v["evidence"]["confidence"].isNotNull()), lambda k, v: v["evidence"]["confidence"])
    return F.map_concat(sure, F.transform_keys(money, lambda k, v: F.concat(F.lit("amounts."), k)))


def with_gaps(inv: DataFrame) -> DataFrame:
    """Missing (sorted), missing critical (fixed order) and low-confidence (sorted) fields."""
    gone = lambda k: F.col(k).isNull()
    return (
        inv.withColumn("field_scores", field_scores())
        .withColumn("missing_fields", F.array_sort(F.array_compact(F.array(*[F.when(gone(k), F.lit(k)) for k in lx.TRACKED_KEYS]))))
        .withColumn("missing_critical_fields", F.array_compact(F.array(*[F.when(gone(k), F.lit(k)) for k in lx.CRITICAL_KEYS])))
        .withColumn("low_confidence_fields", F.array_sort(F.map_keys(F.map_filter("field_scores", lambda k, v: v < lx.LOW_CONFIDENCE))))
    )


def with_confidence(inv: DataFrame) -> DataFrame:
    """Mean of the four deciding scores; 0 when the document cannot be approved anyway."""
    scores = F.array_compact(
        F.array(*[F.try_element_at("field_scores", F.lit(k)) for k in ("vendor", "invoice_number", "issue_date", "amount_due")])
    )
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    score = F.when(
        (F.col("parser_status") != "parsed") | (F.size("missing_critical_fields") > 0) | (F.size(scores) == 0), F.lit(0.0)
    ).otherwise(F.round(mean, 3))
    return inv.withColumn("confidence_score", score).withColumn(
        "confidence_level", tx.confidence_level(F.col("confidence_score"))
    )


def normalize_items(items: DataFrame) -> DataFrame:
    """Line items of N1, one row each."""
    col = F.col
    return items.select(
        "doc_id", "index",
        F.trim(F.coalesce("description.value", "raw", F.lit(""))).alias("description"),
        col("quantity.value").try_cast("decimal(12,4)").alias("quantity"),
        money_field("line_item.unit_price", col("unit_price")).alias("unit_price"),
        money_field("line_item.amount", col("amount")).alias("amount"),
        col("amount.currency").alias("currency"),
        "raw",
        F.struct(
            F.struct("page", "bbox", F.coalesce("row_raw", "raw").alias("raw"), "confidence", "method").alias("row"),
            evidence("line_item.description", col("description")).alias("description"),
            evidence("line_item.quantity", col("quantity")).alias("quantity"),
            evidence("line_item.amount", col("amount")).alias("amount"),
        ).alias("evidence"),
    )
