"""The decision cascade (D1-D20): seventeen checks, first terminal one decides.

Input is one row per invoice (``normalize.normalize_invoices``) with its procurement context
(``match.hydrate_context``). Every check is a column; nothing shuffles except that fuzzy vendor
similarity runs in Python, and only for names no exact identity settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.functions import lexicon as lx
from billgrid.functions import text as tx
from billgrid.functions.dates import date_candidates, normalize_date
from billgrid.functions.similarity import best_similarity
from billgrid.operators.candidates import stage

SAY = lx.DECISION_TEXTS

CHECK = "struct<id:string,status:string,summary:string,evidence:string,context:string>"
#: wider than stored amounts, so that sums and differences of them fit; what doesn't fit is unknown
DEC = "decimal(20,2)"


def _check(name: str, status: Column, summary: Column, evidence: Column, context: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("id"), status.alias("status"), summary.alias("summary"), evidence.alias("evidence"),
        (F.lit("{}") if context is None else context).alias("context"),
    )


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def check_evidence(*keys: str) -> Column:
    """Evidence of the named invoice parts as JSON, absent parts left out."""
    return F.to_json(F.struct(*[F.col(f"{k}.evidence").alias(k) for k in keys]))


def _choose(*cases, otherwise) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


# --- invoice and context values --------------------------------------------------------


def invoice_values() -> dict[str, Column]:
    """Values several checks compare, computed once per row by :func:`with_checks`."""
    none = F.expr("cast(array() as array<string>)")
    cp, ci, cb = F.col("context.purchase_order"), F.col("context.invoice"), F.col("context.buyer")
    own = F.transform(F.map_values("amounts"), lambda a: F.upper(F.trim(a["currency"])))
    items = F.transform(F.coalesce("item_currencies", none), lambda c: F.upper(F.trim(c)))
    blank = tx.null_if_empty

    def wanted_day(key: str) -> Column:
        return normalize_date(F.col(f"context.invoice.{key}"))

    def day_readings(key: str) -> Column:
        return date_candidates(F.col(f"{key}.value"), F.coalesce(blank(F.col(f"{key}.raw")), F.col(f"{key}.evidence.raw")))

    return {
        "_number": F.coalesce(blank(F.col("invoice_number.normalized")), tx.normalize_invoice_number(F.col("invoice_number.value"))),
        "_vendor": F.coalesce(blank(F.col("vendor.normalized_name")), tx.normalize_vendor_name(F.col("vendor.name"))),
        "_buyer": F.coalesce(blank(F.col("buyer.normalized_name")), tx.normalize_vendor_name(F.col("buyer.name"))),
        "_po": F.coalesce(blank(F.col("purchase_order.normalized")), tx.normalize_purchase_order(F.col("purchase_order.value"))),
        "_number_text": F.col("invoice_number.value"),
        "_amount": F.col("amount_due.amount").try_cast(DEC),
        "_amounts": F.transform_values("amounts", lambda k, a: a["amount"].try_cast(DEC)),
        "_currency": F.upper(F.trim(F.coalesce(blank(F.col("currency.value")), F.col("amount_due.currency"), F.lit("")))),
        "_currencies": F.array_sort(F.array_distinct(F.filter(F.concat(own, items), lambda c: c.isNotNull() & (c != "")))),
        "_want_number": tx.normalize_invoice_number(F.coalesce(blank(ci["normalized_invoice_number"]), ci["invoice_number"])),
        "_want_buyer": F.coalesce(blank(cb["normalized_name"]), tx.normalize_vendor_name(cb["name"])),
        "_want_po": F.coalesce(blank(cp["normalized"]), tx.normalize_purchase_order(cp["po_number"])),
        "_want_issue": wanted_day("issue_date"), "_want_due": wanted_day("due_date"),
        "_issue_days": day_readings("issue_date"), "_due_days": day_readings("due_date"),
        "_account": F.coalesce(tx.mask_account(F.col("bank_details.bank_account")), tx.mask_account(F.col("context.invoice_payment.bank_account"))),
        "_want_account": tx.mask_account(F.col("context.approved_bank_account")),
    }


def invoice_number() -> Column:
    return F.col("_number")


def invoice_vendor() -> Column:
    return F.col("_vendor")


def invoice_buyer() -> Column:
    return F.col("_buyer")


def invoice_po() -> Column:
    return F.col("_po")


def invoice_amount() -> Column:
    return F.col("_amount")


def _amount(key: str) -> Column:
    return F.try_element_at("_amounts", F.lit(key))


def invoice_currency() -> Column:
    return F.col("_currency")


def money_currencies() -> Column:
    return F.col("_currencies")


# --- D1..D17 ---------------------------------------------------------------------------


def d_text_layer() -> Column:
    gone = F.coalesce("no_text_layer", F.lit(False))
    return _check(
        "text_layer", F.when(gone, "fail").otherwise("pass"),
        F.when(gone, SAY["parser_reported_no_usable_text"]).otherwise(SAY["parser_extracted_a_usable_text"]),
        _json(parser_status=F.col("parser_status")),
    )


def d_critical() -> Column:
    gone = F.size("missing_critical_fields") > 0
    return _check(
        "critical_fields", F.when(gone, "fail").otherwise("pass"),
        F.when(gone, F.concat(F.lit(SAY["missing_critical_fields"]), F.array_join("missing_critical_fields", ", "), F.lit(".")))
        .otherwise(SAY["critical_invoice_fields_were_extracted"]),
        F.when(gone, _json(missing_critical_fields=F.col("missing_critical_fields")))
        .otherwise(check_evidence("vendor", "invoice_number", "issue_date", "amount_due")),
    )


def d_confidence() -> Column:
    low = F.size("low_confidence_fields") > 0
    return _check(
        "parse_confidence", F.when(low, "review").otherwise("pass"),
        F.when(low, F.concat(F.lit(SAY["low_confidence_parsed_fields"]), F.array_join("low_confidence_fields", ", "), F.lit(".")))
        .otherwise(SAY["parsed_fields_meet_confidence_threshold"]),
        _json(
            score=F.col("confidence_score"), level=F.col("confidence_level"),
            low_confidence_fields=F.col("low_confidence_fields"), parse_warnings=F.col("parse_warnings"),
        ),
    )


def d_parser_status() -> Column:
    s = F.coalesce("parser_status", F.lit("unknown"))
    return _check(
        "parser_status", F.when(s == "parsed", "pass").when(s == "needs_review", "review").otherwise("fail"),
        F.when(s == "parsed", SAY["parser_completed_without_review_status"])
        .when(s == "needs_review", SAY["parser_marked_the_invoice_as"])
        .otherwise(F.concat(F.lit(SAY["parser_did_not_produce_an"]), s, F.lit(")."))),
        _json(parser_status=s, parse_warnings=F.col("parse_warnings"), missing_fields=F.col("missing_fields")),
    )


def d_context() -> Column:
    ok = F.coalesce("context_available", F.lit(False))
    return _check(
        "procurement_context", F.when(ok, "pass").otherwise("fail"),
        F.when(ok, SAY["procurement_context_loaded"]).otherwise(F.coalesce("context_reason", F.lit(SAY["procurement_context_is_unavailable"]))),
        F.lit("{}"),
        F.when(ok, _json(source=F.col("context_source"), scenario=F.col("context_scenario"))).otherwise(_json(available=F.lit(False))),
    )


def vendor_values() -> dict[str, Column]:
    """Identity of the approved vendor and identifiers of the invoice's, in normal form."""
    cv = F.col("context.vendor")
    none = F.expr("cast(array() as array<string>)")
    approved = F.coalesce(tx.null_if_empty(cv["normalized_name"]), tx.normalize_vendor_name(cv["name"]))
    aliases = F.array_sort(F.array_distinct(F.filter(
        F.transform(F.coalesce(cv["aliases"], none), lambda a: tx.normalize_vendor_name(a)), lambda a: a != ""
    )))
    clean = lambda ids, fn: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(ids, none), lambda v: fn(v)), lambda v: v != "")))
    return {
        "_approved": approved, "_aliases": aliases, "_tax": tx.normalize_tax_identifier(cv["tax_id"]),
        "_vid": tx.normalize_identifier(cv["vendor_id"]), "_tax_ids": clean(F.col("vendor.tax_ids"), tx.normalize_tax_identifier),
        "_vendor_ids": clean(F.col("vendor.vendor_ids"), tx.normalize_identifier),
    }


def _vendor_facts(df: DataFrame) -> DataFrame:
    """Vendor identity comparisons; similarity is asked only where nothing exact matched."""
    named = F.col("_vendor") != ""
    how = (
        F.when((F.col("_approved") == "") & (F.size("_aliases") == 0) & (F.col("_tax") == "") & (F.col("_vid") == ""), "unknown")
        .when(named & (F.col("_vendor") == F.col("_approved")), "normalized_name")
        .when(named & F.array_contains("_aliases", F.col("_vendor")), "approved_alias")
        .when((F.col("_tax") != "") & F.array_contains("_tax_ids", F.col("_tax")), "tax_id")
        .when((F.col("_vid") != "") & F.array_contains("_vendor_ids", F.col("_vid")), "vendor_id")
    )
    df = df.withColumn("_how", how)
    open_ = ~F.coalesce(F.col("_how"), F.lit("")).isin("normalized_name", "approved_alias", "unknown") & F.coalesce(
        F.col("context_available"), F.lit(False)
    )
    names = F.filter(F.concat(F.array("_approved"), "_aliases"), lambda n: n != "")
    # rows an exact identity settled reach Python as NULL and cost nothing there
    return df.withColumn("_sim", best_similarity(F.when(open_, F.col("_vendor")), F.when(open_, names)))


def d_vendor() -> Column:
    how, sim = F.col("_how"), F.col("_sim")
    fuzzy = sim >= lx.FUZZY_VENDOR
    exact = how.isin("normalized_name", "approved_alias", "tax_id", "vendor_id")
    status = F.when(how == "unknown", "review").when(exact, "pass").when(fuzzy, "review").otherwise("fail")
    summary = (
        F.when(how == "unknown", SAY["no_approved_vendor_identity_is"])
        .when(how == "normalized_name", SAY["invoice_vendor_matches_approved_vendor"])
        .when(how == "approved_alias", SAY["invoice_vendor_matches_an_approved"])
        .when(how == "tax_id", SAY["invoice_vendor_tax_identifier_matches"])
        .when(how == "vendor_id", SAY["invoice_vendor_identifier_matches_approved"])
        .when(fuzzy, SAY["invoice_vendor_is_a_close"])
        .otherwise(SAY["invoice_vendor_does_not_match"])
    )
    return _check(
        "vendor_match", status, summary,
        _json(vendor=F.col("vendor.evidence"), normalized_vendor=F.col("_vendor"), tax_ids=F.col("_tax_ids"), vendor_ids=F.col("_vendor_ids")),
        _json(
            vendor=F.col("context.vendor"),
            match_method=F.coalesce(how, F.when(fuzzy, "fuzzy_name").otherwise("none")),
            similarity=F.round(F.when(how.isin("normalized_name", "approved_alias"), F.lit(1.0)).otherwise(sim), 3),
        ),
    )


def d_buyer() -> Column:
    cb, want = F.col("context.buyer"), F.col("_want_buyer")
    same = invoice_buyer() == want
    return _check(
        "buyer_match", F.when(want == "", "not_applicable").when(same, "pass").otherwise("fail"),
        F.when(want == "", SAY["accounts_payable_context_does_not"])
        .when(same, SAY["invoice_buyer_matches_the_approved"])
        .otherwise(SAY["invoice_buyer_does_not_match"]),
        check_evidence("buyer"), _json(buyer=cb),
    )


def d_currency() -> Column:
    have = invoice_currency()
    want = F.upper(F.trim(F.coalesce("context.currency", F.lit(""))))
    odd = F.size(F.array_except(money_currencies(), F.array(have))) > 0
    same = have == want
    return _check(
        "currency_match",
        F.when(odd, "fail").when(want == "", "not_applicable").when(same, "pass").otherwise("fail"),
        F.when(odd, SAY["invoice_monetary_fields_contain_inconsistent"])
        .when(want == "", SAY["accounts_payable_context_does_not_specify"])
        .when(same, SAY["invoice_currency_matches_accounts_payable"])
        .otherwise(SAY["invoice_currency_does_not_match"]),
        _json(currency=F.col("currency.evidence"), invoice_currency=have, money_currencies=money_currencies()),
        _json(expected_currency=tx.null_if_empty(want)),
    )


def d_duplicate() -> Column:
    number, vendor = invoice_number(), invoice_vendor()
    cands = F.coalesce("context.duplicate_candidates", F.slice("context.previous_invoices", 1, 0))
    hits = F.filter(
        cands,
        lambda c: (c["normalized_invoice_number"] == number)
        & ((F.coalesce(c["normalized_vendor"], F.lit("")) == "") | (vendor == "") | (c["normalized_vendor"] == vendor)),
    )
    dup = F.coalesce(F.size(hits), F.lit(0)) > 0
    return _check(
        "duplicate_invoice", F.when(dup, "fail").otherwise("pass"),
        F.when(dup, SAY["normalized_invoice_number_matches_a"]).otherwise(SAY["no_duplicate_invoice_candidate_matched"]),
        check_evidence("invoice_number", "vendor", "amount_due"),
        F.when(dup, _json(candidates=hits)).otherwise(_json(candidate_count=F.coalesce(F.size(cands), F.lit(0)))),
    )


def d_number() -> Column:
    want = F.col("_want_number")
    same = invoice_number() == want
    return _check(
        "invoice_number_match", F.when(want == "", "not_applicable").when(same, "pass").otherwise("fail"),
        F.when(want == "", SAY["accounts_payable_context_does_not_specify_an"])
        .when(same, SAY["invoice_number_matches_the_accounts"])
        .otherwise(SAY["invoice_number_does_not_match"]),
        _json(invoice_number=F.col("invoice_number.evidence"), normalized_invoice_number=invoice_number()),
        _json(expected_normalized_invoice_number=tx.null_if_empty(want)),
    )


def d_dates() -> Column:
    wi, wd = F.col("_want_issue"), F.col("_want_due")
    off_i = wi.isNotNull() & ~F.array_contains("_issue_days", wi)
    off_d = wd.isNotNull() & ~F.array_contains("_due_days", wd)
    wrong = F.array_compact(F.array(F.when(off_i, F.lit("issue_date")), F.when(off_d, F.lit("due_date"))))
    none, bad = wi.isNull() & wd.isNull(), F.size(wrong) > 0
    return _check(
        "date_match", F.when(none, "not_applicable").when(bad, "fail").otherwise("pass"),
        F.when(none, SAY["accounts_payable_context_does_not_specify_expected"])
        .when(bad, F.concat(F.lit(SAY["invoice_date_fields_do_not"]), F.array_join(wrong, ", "), F.lit(".")))
        .otherwise(SAY["invoice_dates_match_accounts_payable"]),
        _json(issue_date=normalize_date(F.col("issue_date.value")), due_date=normalize_date(F.col("due_date.value"))),
        _json(issue_date=wi, due_date=wd),
    )


def d_bank() -> Column:
    approved, have = F.col("_want_account"), F.col("_account")
    same = have.eqNullSafe(approved)
    return _check(
        "bank_details", F.when(approved.isNull() | same, "pass").otherwise("fail"),
        F.when(approved.isNull(), SAY["no_approved_bank_account_override"])
        .when(same, SAY["invoice_bank_account_matches_vendor"])
        .otherwise(SAY["invoice_bank_account_differs_from"]),
        _json(invoice_bank_account=have, bank_details=F.col("bank_details.evidence")), _json(approved_bank_account=approved),
    )


def d_credit() -> Column:
    amount = invoice_amount()
    scenario = F.coalesce("context_scenario", F.lit(""))
    credit = (
        F.coalesce(amount < 0, F.lit(False))
        | F.coalesce("item_negative", F.lit(False))
        | F.coalesce(F.upper("_number_text").startswith("CM-"), F.lit(False))
        | (scenario == "credit_memo_negative_balance")
    )
    return _check(
        "credit_memo", F.when(credit, "review").otherwise("pass"),
        F.when(credit, SAY["credit_memo_or_negative_balance"]).otherwise(SAY["invoice_is_not_a_credit"]),
        _json(amount_due=amount.cast("string"), has_negative_line_items=F.coalesce("item_negative", F.lit(False))),
        _json(scenario=scenario),
    )


def _po_case() -> tuple[Column, Column, Column]:
    have, want = invoice_po(), F.col("_want_po")
    cand = F.col("context.candidate_open_po")
    return (have == "") & cand.isNotNull(), have == "", (want != "") & (have != want)


def d_po() -> Column:
    hinted, missing, other = _po_case()
    cand = F.col("context.candidate_open_po")
    return _check(
        "purchase_order", F.when(hinted | missing | other, "review").otherwise("pass"),
        F.when(hinted, F.concat(F.lit(SAY["invoice_omits_a_purchase_order"]), F.coalesce(cand["po_number"], F.lit("None")), F.lit(".")))
        .when(missing, SAY["invoice_omits_a_purchase_order"])
        .when(other, SAY["invoice_purchase_order_does_not"])
        .otherwise(SAY["invoice_purchase_order_matches_accounts"]),
        check_evidence("purchase_order"),
        F.when(hinted, _json(candidate_open_po=cand)).otherwise(_json(purchase_order=F.col("context.purchase_order"))),
    )


def po_next_action() -> Column:
    hinted, missing, _ = _po_case()
    return (
        F.when(hinted, F.concat(F.lit(SAY["route_to_review_and_attach"]), F.coalesce("context.candidate_open_po.po_number", F.lit("None")), F.lit(".")))
        .when(missing, SAY["request_the_purchase_order_reference"])
        .otherwise(SAY["review_the_po_mismatch_before"])
    )


def d_composition() -> Column:
    """Signed discount here, unlike validation V2 which takes its absolute value."""
    cent, zero = F.lit("0.01").try_cast(DEC), F.lit("0.00").try_cast(DEC)
    subtotal, balance = _amount("subtotal"), invoice_amount()
    part = {k: F.coalesce(_amount(k), zero) for k in ("discount", "tax", "shipping", "paid")}
    expected = subtotal - part["discount"] + part["tax"] + part["shipping"] - part["paid"]
    variance = balance - expected
    wrong = []
    for k in lx.MONEY_KEYS:
        have = balance if k == "balance_due" else _amount(k)
        want = F.try_element_at("context.amounts", F.lit(k)).try_cast(DEC)
        differs = want.isNotNull() & F.when(have.isNull(), want != 0).otherwise(F.abs(have - want) > cent)
        wrong.append(F.when(
            differs, F.struct(F.lit(k).alias("key"), F.struct(have.cast("string").alias("actual"), want.cast("string").alias("expected")).alias("value"))
        ))
    mismatches = F.array_compact(F.array(*wrong))
    lines = F.col("item_total").cast("decimal(14,2)")
    line_variance = F.when(F.col("item_amounts") > 0, lines - subtotal)
    failures = F.array_compact(F.array(
        F.when(F.abs(variance) > cent, F.lit("summary arithmetic")),
        F.when(F.size(mismatches) > 0, F.lit(SAY["accounts_payable_amount_components"])),
        F.when(F.coalesce(F.abs(line_variance) > cent, F.lit(False)), F.lit("line-item subtotal")),
    ))
    na, unknown, bad = subtotal.isNull(), balance.isNull(), F.size(failures) > 0
    return _check(
        "amount_composition",
        F.when(na, "not_applicable").when(unknown, "review").when(bad, "fail").otherwise("pass"),
        F.when(na, SAY["invoice_does_not_expose_a"])
        .when(unknown, SAY["invoice_balance_due_is_unavailable"])
        .when(bad, F.concat(F.lit(SAY["invoice_amount_composition_does_not"]), F.array_join(failures, ", "), F.lit(".")))
        .otherwise(SAY["subtotal_discounts_aggregate_tax_shipping"]),
        _json(
            subtotal=subtotal.cast("string"), **{k: v.cast("string") for k, v in part.items()}, balance_due=balance.cast("string"),
            calculated_balance=expected.try_cast(DEC).cast("string"), composition_variance=variance.try_cast(DEC).cast("string"),
            line_item_total=F.when(F.col("item_amounts") > 0, lines.cast("string")), line_item_variance=line_variance.cast("string"),
        ),
        _json(component_mismatches=F.map_from_entries(mismatches)),
    )


def d_partial() -> Column:
    po = F.col("context.purchase_order")
    consumed = F.coalesce(po["previously_consumed"], F.lit(0).try_cast(DEC))
    remaining, amount = po["remaining_before_invoice"], invoice_amount()
    prior = F.coalesce(F.size("context.previous_invoices"), F.lit(0))
    none = (consumed <= 0) & (prior <= 0)
    unknown = amount.isNull() | remaining.isNull()
    fits = (amount >= 0) & (amount <= remaining)
    return _check(
        "partial_po_consumption",
        F.when(none, "not_applicable").when(unknown, "review").when(fits, "pass").otherwise("fail"),
        F.when(none, SAY["no_prior_po_consumption_is"])
        .when(unknown, SAY["partial_po_context_is_present"])
        .when(fits, SAY["invoice_amount_is_within_remaining"])
        .otherwise(SAY["invoice_amount_exceeds_remaining_po"]),
        check_evidence("amount_due", "purchase_order"),
        _json(purchase_order=po, previous_invoice_count=prior, remaining_after_invoice=(remaining - amount).try_cast(DEC).cast("string")),
    )


def d_amount() -> Column:
    po = F.col("context.purchase_order")
    expected = F.when(F.col("context.variance_amount").isNotNull(), po["authorized_total"]).otherwise(
        F.coalesce("context.invoice_total", po["authorized_total"])
    )
    tolerance = F.coalesce("context.tolerance_policy.amount", F.lit(0).try_cast(DEC))
    amount = invoice_amount()
    variance = amount - expected
    unknown = amount.isNull() | expected.isNull()
    return _check(
        "amount_match",
        F.when(unknown, "review").when(variance == 0, "pass").when(F.abs(variance) <= tolerance, "pass_with_tolerance").otherwise("fail"),
        F.when(unknown, SAY["invoice_amount_or_accounts_payable"])
        .when(variance == 0, SAY["invoice_amount_matches_accounts_payable"])
        .when(F.abs(variance) <= tolerance, SAY["invoice_amount_variance_is_within"])
        .otherwise(SAY["invoice_amount_variance_exceeds_tolerance"]),
        check_evidence("amount_due"),
        _json(expected_amount=expected.cast("string"), variance=variance.try_cast(DEC).cast("string"), tolerance_policy=F.col("context.tolerance_policy")),
    )


#: check columns in the order they are recorded
CHECKS = (
    ("text_layer", d_text_layer), ("critical_fields", d_critical), ("parse_confidence", d_confidence),
    ("parser_status", d_parser_status), ("procurement_context", d_context), ("vendor_match", d_vendor),
    ("buyer_match", d_buyer), ("currency_match", d_currency), ("duplicate_invoice", d_duplicate),
    ("invoice_number_match", d_number), ("date_match", d_dates), ("bank_details", d_bank),
    ("credit_memo", d_credit), ("purchase_order", d_po), ("amount_composition", d_composition),
    ("partial_po_consumption", d_partial), ("amount_match", d_amount),
)


def _review_level(with_context: bool = False) -> Column:
    good = F.col("confidence_level").isin("high", "medium")
    return F.when(good, "high" if with_context else "medium").otherwise("low")


def _approval_level() -> Column:
    return F.when(F.col("confidence_level") == "high", "high").otherwise("medium")


def _outcomes() -> list[tuple]:
    """Terminal outcomes in test order: (check, statuses, decision, confidence, summary, action).

    The parser status is tested before parse confidence although it is recorded after it, and
    a fitting partial consumption ends the cascade before the total is compared. NULL summary
    or action means the check's own.
    """
    low, mid, ok = F.lit("low"), _review_level(), _approval_level()
    review, ask = "needs_review", "request_missing_info"
    resolve = SAY["resolve_the_parser_review_findings"]
    return [
        ("text_layer", ["fail"], ask, low, SAY["invoice_text_could_not_be"],
         SAY["request_a_text_searchable_invoice"]),
        ("critical_fields", ["fail"], ask, low, SAY["required_invoice_fields_are_missing"],
         SAY["ask_the_vendor_for_the"]),
        ("parser_status", ["review"], review, low, None, resolve),
        ("parser_status", ["fail"], ask, low, None, resolve),
        ("parse_confidence", ["review"], review, mid, None,
         SAY["validate_the_low_confidence_fields"]),
        ("procurement_context", ["fail"], review, low, SAY["procurement_context_is_missing"],
         SAY["load_po_vendor_master_duplicate"]),
        ("vendor_match", ["fail", "review"], review, mid, None,
         SAY["review_vendor_identity_aliases_and"]),
        ("buyer_match", ["fail", "review"], review, mid, None,
         SAY["confirm_that_the_invoice_is"]),
        ("currency_match", ["fail", "review"], review, mid, None,
         SAY["confirm_invoice_and_purchase_order"]),
        ("duplicate_invoice", ["fail"], "flag_possible_duplicate", mid, SAY["invoice_may_duplicate_a_prior"],
         SAY["hold_payment_and_compare_the"]),
        ("invoice_number_match", ["fail"], review, mid, None,
         SAY["resolve_the_invoice_number_mismatch"]),
        ("date_match", ["fail"], review, mid, None,
         SAY["resolve_invoice_or_due_date"]),
        ("bank_details", ["fail"], "block_or_escalate", _review_level(True),
         SAY["invoice_payment_details_differ_from"],
         SAY["block_payment_and_escalate_the"]),
        ("credit_memo", ["review"], "apply_credit_or_route_review", mid,
         SAY["invoice_appears_to_be_a"],
         SAY["apply_the_credit_to_open"]),
        ("purchase_order", ["review"], review, mid, None, None),
        ("amount_composition", ["fail", "review"], review, mid, None,
         SAY["reconcile_subtotal_discounts_aggregate_tax"]),
        ("partial_po_consumption", ["pass"], "approve_partial_consumption", ok,
         SAY["invoice_fits_within_the_remaining"],
         SAY["approve_the_invoice_and_consume"]),
        ("partial_po_consumption", ["fail", "review"], review, mid, None,
         SAY["resolve_the_remaining_purchase_order"]),
        ("amount_match", ["pass_with_tolerance"], "approve_with_tolerance", ok,
         SAY["invoice_variance_is_within_the"],
         SAY["approve_with_a_tolerance_note"]),
        ("amount_match", ["fail"], review, mid,
         SAY["invoice_amount_is_outside_the"],
         SAY["route_to_accounts_payable_review"]),
        ("amount_match", ["review"], review, mid, None,
         SAY["load_the_missing_expected_amount"]),
    ]


def with_checks(inv: DataFrame) -> DataFrame:
    """All seventeen checks as struct columns ``chk_<id>``.

    Plain projections: what is named more than once is made once, what nobody reads is not made.
    """
    made = {name: fn() for name, fn in CHECKS}
    df = _vendor_facts(inv.withColumns(invoice_values() | vendor_values()))
    df = df.withColumns({f"_is_{name}": c["status"] for name, c in made.items()})
    return df.withColumns({
        f"chk_{name}": F.struct(c["id"].alias("id"), F.col(f"_is_{name}").alias("status"), *[c[k].alias(k) for k in ("summary", "evidence", "context")])
        for name, c in made.items()
    })


def decide(inv: DataFrame) -> DataFrame:
    """Decision, confidence, summary, next action, recorded checks and audit."""
    df = with_checks(inv)
    names = [n for n, _ in CHECKS]
    outs = _outcomes()
    first = F.coalesce(
        *[F.when(F.col(f"_is_{o[0]}").isin(*o[1]), F.lit(i)) for i, o in enumerate(outs)], F.lit(len(outs))
    )
    df = df.withColumn("_o", first)
    # how many checks stand in the record: parse confidence is only acted on after parser status
    depth = [max(names.index(o[0]), 3 if o[0] == "parse_confidence" else 0) + 1 for o in outs] + [len(names)]
    pick = lambda values: F.get(F.array(*values), F.col("_o"))
    own = lambda o: F.col(f"chk_{o[0]}.summary")
    done = SAY["vendor_purchase_order_payment_details"]
    checks = F.array(*[F.col(f"chk_{n}") for n in names])
    return df.select(
        *[c for c in ("doc_id", "owner") if c in df.columns],
        pick([F.lit(o[2]) for o in outs] + [F.lit("approve")]).alias("decision"),
        pick([o[3] for o in outs] + [_approval_level()]).alias("confidence"),
        pick([own(o) if o[4] is None else F.lit(o[4]) for o in outs] + [F.lit(done)]).alias("summary"),
        pick([po_next_action() if o[5] is None else F.lit(o[5]) for o in outs] + [F.lit(SAY["approve_the_invoice_for_payment"])]).alias("next_action"),
        F.slice(checks, F.lit(1), pick([F.lit(d) for d in depth])).cast(f"array<{CHECK}>").alias("checks"),
        audit().alias("audit"),
        F.col("context.expected_decision").alias("expected_decision"),
    )


def audit() -> Column:
    """What the decision was based on."""
    return F.struct(
        "parser_status", "parser_version", invoice_number().alias("normalized_invoice_number"),
        invoice_vendor().alias("normalized_vendor"), invoice_po().alias("purchase_order"),
        invoice_amount().alias("amount_due"), F.col("context_source").alias("context_source"),
        F.col("context_scenario").alias("context_scenario"),
    )


def explode_checks(decisions: DataFrame) -> DataFrame:
    """One row per recorded check."""
    # staged: the filter that Spark infers from exploding a column would copy all of its expressions
    decisions = stage(decisions.select("doc_id", "decision", "checks"), checks=F.col("checks"))
    return decisions.select("doc_id", "decision", F.posexplode("checks").alias("position", "c")).select(
        "doc_id", "decision", (F.col("position") + 1).alias("position"), "c.*"
    )
