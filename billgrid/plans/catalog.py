"""Registered queries: every operator over the whole given tables, with its SQL check."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid.functions import boxes, dates, keys, money, text
from billgrid.functions import lexicon as lx
from billgrid.operators import candidates, decide, evaluate, extract, grid, mail, match, merge, normalize, profile, queue, tables, truth, validate
from billgrid.operators import fields as fields_
from billgrid.plans import fixtures as fx
from billgrid.plans import stored

from billgrid.plans.checks_sql import DECIDE, ITEMS, MATCH, with_inv
from billgrid.session import materialize, work_dir
from billgrid.sources import keyed, sinks
from billgrid.sources import tables as readers
from billgrid.streaming import events, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def joined(c: Column) -> Column:
    return F.array_join(c, ",")


# --- decisions, matching, normalization ------------------------------------------------


def _norm_and_ap(spark, sf):
    """Normalized invoices and procurement records. Both are many times as wide as the rows they are made of, which are
    stored in their place and spread by the key they will be asked by."""
    inv = _kept(spark, sf, "invoice-view", lambda: fx.invoices(spark, sf))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # what is small here isn't when it is joined
    return fx.normalized(inv.repartition(n, "doc_id")), fx.ap_records(inv.repartition(n, "k"))


def _hydrated(spark, sf):
    norm, ap = _norm_and_ap(spark, sf)
    return match.hydrate_context(norm, match.match_ap_context(match.match_keys(norm), ap), ap)


@query("d18_decisions", with_inv("SELECT doc_id, owner, decision, confidence FROM final", MATCH, DECIDE))
def d18_decisions(spark, sf):
    return decide.decide(_hydrated(spark, sf)).select("doc_id", "owner", "decision", "confidence")


@query("d18_decision_counts", with_inv("SELECT decision, COUNT(*) AS n FROM final GROUP BY decision", MATCH, DECIDE))
def d18_decision_counts(spark, sf):
    return decide.decide(_hydrated(spark, sf)).groupBy("decision").agg(F.count("*").alias("n"))


@query("d19_explode_checks")
def d19_explode_checks(spark, sf):
    return decide.explode_checks(decide.decide(_hydrated(spark, sf))).select("doc_id", "decision", "position", "id", "status", "summary")


@query("d20_audit", with_inv(
    "SELECT f.doc_id, CAST(f.k AS VARCHAR) AS number, lower(replace(COALESCE(vendor, ''), '#', ' ')) AS vendor, "
    "replace(purchase_order, '-', '') AS purchase_order, balance_due AS amount_due FROM final f JOIN inv USING (doc_id)", MATCH, DECIDE))
def d20_audit(spark, sf):
    return decide.decide(_hydrated(spark, sf)).select(
        "doc_id", F.col("audit.normalized_invoice_number").alias("number"), F.col("audit.normalized_vendor").alias("vendor"),
        F.col("audit.purchase_order").alias("purchase_order"), F.col("audit.amount_due").alias("amount_due"),
    )


_OK = "CASE WHEN ap_id IS NOT NULL THEN 1 END"
#: per-check SQL over every invoice, whether or not the cascade would reach the check
_STATUS = {
    "text_layer": "CASE WHEN k % 23 = 0 THEN 'fail' ELSE 'pass' END",
    "critical_fields": "CASE WHEN vendor IS NULL THEN 'fail' ELSE 'pass' END",
    "parse_confidence": "CASE WHEN k % 17 = 0 THEN 'review' ELSE 'pass' END",
    "parser_status": "CASE WHEN k % 23 = 0 THEN 'fail' WHEN k % 19 = 0 THEN 'review' ELSE 'pass' END",
    "procurement_context": "CASE WHEN ap_id IS NULL THEN 'fail' ELSE 'pass' END",
    "bank_details": "CASE WHEN ap_id IS NULL OR a_supp IS NULL THEN 'pass' WHEN bank_account IS NOT DISTINCT FROM '**** ' || printf('%04d', (a_supp + CASE WHEN s = 6 THEN 1 ELSE 0 END) % 10000) THEN 'pass' ELSE 'fail' END",
    "credit_memo": "CASE WHEN balance_due < 0 OR s = 7 THEN 'review' ELSE 'pass' END",
    "duplicate_invoice": "CASE WHEN s = 4 AND a_number = invoice_number THEN 'fail' ELSE 'pass' END",
    "invoice_number_match": "CASE WHEN ap_id IS NULL OR ap_id % 13 = 0 THEN 'not_applicable' WHEN a_number = invoice_number THEN 'pass' ELSE 'fail' END",
    "date_match": "CASE WHEN ap_id IS NULL THEN 'not_applicable' WHEN a_issue = issue_date THEN 'pass' ELSE 'fail' END",
    "buyer_match": "CASE WHEN ap_id IS NULL THEN 'not_applicable' WHEN a_buyer = buyer THEN 'pass' ELSE 'fail' END",
    "currency_match": "CASE WHEN ap_id IS NULL THEN 'not_applicable' ELSE 'pass' END",
    "purchase_order": "CASE WHEN purchase_order = '' THEN 'review' WHEN ap_id IS NULL THEN 'pass' WHEN s = 5 THEN 'review' WHEN ap_id % 13 <> 0 AND a_po <> '' AND a_po <> purchase_order THEN 'review' ELSE 'pass' END",
    "amount_composition": "CASE WHEN ap_id IS NOT NULL AND (a_sub <> subtotal OR a_disc <> discount OR a_tax <> tax OR a_total <> balance_due) THEN 'fail' ELSE 'pass' END",
    "partial_po_consumption": "CASE WHEN s = 1 THEN CASE WHEN balance_due <= authorized - CAST(a_total / 4 AS DECIMAL(12,2)) AND balance_due >= 0 THEN 'pass' ELSE 'fail' END ELSE 'not_applicable' END",
    "amount_match": "CASE WHEN ap_id IS NULL THEN 'review' WHEN s IN (2, 3) THEN CASE WHEN balance_due = authorized THEN 'pass' WHEN abs(balance_due - authorized) <= CAST(round(CAST(authorized AS DECIMAL(18,6)) * 2 / 100, 2) AS DECIMAL(12,2)) THEN 'pass_with_tolerance' ELSE 'fail' END WHEN balance_due = a_total THEN 'pass' ELSE 'fail' END",
}


def _status_query(name: str):
    def run(spark, sf):
        return decide.with_checks(_hydrated(spark, sf)).select("doc_id", F.col(f"chk_{name}.status").alias("status"))

    return run


for _i, (_name, _) in enumerate(decide.CHECKS, start=1):
    if _name in _STATUS:
        query(f"d{_i:02d}_{_name}", with_inv(f"SELECT doc_id, {_STATUS[_name]} AS status FROM ctx2", MATCH, DECIDE))(_status_query(_name))
    else:
        query(f"d{_i:02d}_{_name}")(_status_query(_name))


@query("j08_match_ap_context", with_inv("SELECT doc_id, ap_id, match_strategy FROM matched", MATCH))
def j08(spark, sf):
    inv = fx.invoices(spark, sf)
    return match.match_ap_context(match.match_keys(fx.normalized(inv)), fx.ap_records(inv)).select("doc_id", "ap_id", "match_strategy")


@query("j11_context_coverage", with_inv(
    "SELECT i.doc_id, ap_id IS NOT NULL AS context_matched, match_strategy, ap_id FROM inv i LEFT JOIN matched USING (doc_id)", MATCH))
def j11(spark, sf):
    inv = fx.invoices(spark, sf)
    return match.context_coverage(match.match_keys(fx.normalized(inv)), fx.ap_records(inv)).drop("scenario")


@query("j09_match_strategy", with_inv("SELECT match_strategy, COUNT(*) AS n FROM matched GROUP BY 1", MATCH))
def j09(spark, sf):
    inv = fx.invoices(spark, sf)
    return match.match_ap_context(match.match_keys(fx.normalized(inv)), fx.ap_records(inv)).groupBy("match_strategy").agg(F.count("*").alias("n"))


@query("w02_best_ap_candidate")
def w02(spark, sf):
    sup = fx.table(spark, sf, "supplier")
    cands = fx.table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("updated_at")).join(
        sup, F.col("l_suppkey") == F.col("s_suppkey")
    ).select("l_partkey", "updated_at", F.col("l_suppkey").alias("ap_id"), text.normalize_vendor_name(F.col("s_name")).alias("ap_vendor"),
             F.concat(F.lit("supplier 00"), F.col("l_partkey").cast("string")).alias("asked"))
    return match.best_ap_candidate(cands, ["l_partkey"], "asked").select("l_partkey", "ap_id", "similarity")


@query("j10_select_document", with_inv("""
    SELECT i.doc_id, arg_max(d.doc_id, (CASE WHEN i.k = d.k THEN 4 ELSE 0 END
      + CASE WHEN i.purchase_order <> '' AND i.purchase_order = d.purchase_order THEN 3 ELSE 0 END
      + CASE WHEN i.vendor = d.vendor THEN 2 ELSE 0 END
      + CASE WHEN abs(i.balance_due - d.balance_due) <= 0.01 THEN 1 ELSE 0 END)::BIGINT * 1000000000 - d.k) AS document_id
    FROM inv i JOIN inv d ON CAST(floor(i.k / 16) AS BIGINT) = CAST(floor(d.k / 16) AS BIGINT) GROUP BY i.doc_id"""))
def j10(spark, sf):
    inv = fx.invoices(spark, sf).select(
        "doc_id", F.floor(F.col("k") / 16).alias("source"), F.col("k").alias("position"), text.normalize_invoice_number(F.col("invoice_number")).alias("number"),
        text.normalize_purchase_order(F.col("purchase_order")).alias("po"), text.normalize_vendor_name(F.col("vendor")).alias("vendor"), F.col("balance_due").alias("amount"),
    )
    return match.select_document(inv.withColumn("wanted", F.lit(None).cast("string")), inv.withColumnRenamed("doc_id", "document_id")).select("doc_id", "document_id")


@query("n01_normalize_invoices", with_inv("""
    SELECT doc_id, CAST(k AS VARCHAR) AS number, replace(purchase_order, '-', '') AS po, lower(replace(vendor, '#', ' ')) AS vendor,
      lower(replace(buyer, '#', ' ')) AS buyer, balance_due AS amount_due, bank_account FROM inv"""))
def n01(spark, sf):
    n = fx.normalized(fx.invoices(spark, sf))
    return n.select(
        "doc_id", F.col("invoice_number.normalized").alias("number"), F.coalesce("purchase_order.normalized", F.lit("")).alias("po"),
        F.col("vendor.normalized_name").alias("vendor"), F.col("buyer.normalized_name").alias("buyer"), F.col("amount_due.amount").alias("amount_due"),
        F.col("bank_details.bank_account").alias("bank_account"),
    )


@query("p18_field_gaps", with_inv("""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN purchase_order = '' THEN 'purchase_order' END, CASE WHEN vendor IS NULL THEN 'vendor' END], lambda x: x IS NOT NULL), ',') AS missing,
      CASE WHEN vendor IS NULL THEN 'vendor' ELSE '' END AS critical, CASE WHEN k % 17 = 0 THEN 'issue_date' ELSE '' END AS low FROM inv"""))
def p18(spark, sf):
    n = fx.normalized(fx.invoices(spark, sf))
    return n.select("doc_id", joined(F.col("missing_fields")).alias("missing"), joined(F.col("missing_critical_fields")).alias("critical"), joined(F.col("low_confidence_fields")).alias("low"))


@query("a09_overall_confidence", with_inv("""
    SELECT doc_id, CASE WHEN k % 23 = 0 OR k % 19 = 0 OR vendor IS NULL THEN 0.0 WHEN k % 17 = 0 THEN 0.85 ELSE 0.95 END::DOUBLE AS score,
      CASE WHEN k % 23 = 0 OR k % 19 = 0 OR vendor IS NULL THEN 'low' ELSE 'high' END AS level FROM inv"""))
def a09(spark, sf):
    return fx.normalized(fx.invoices(spark, sf)).select("doc_id", F.col("confidence_score").alias("score"), F.col("confidence_level").alias("level"))


@query("n02_field_scores", with_inv("""
    SELECT field, COUNT(*) AS n, round(SUM(c), 2) AS total FROM (
      SELECT unnest(['invoice_number', 'due_date', 'terms', 'currency', 'buyer', 'amount_due', 'amounts.subtotal', 'amounts.discount', 'amounts.tax', 'amounts.balance_due']) AS field, 0.95 AS c FROM inv
      UNION ALL SELECT 'issue_date', CASE WHEN k % 17 = 0 THEN 0.55 ELSE 0.95 END FROM inv
      UNION ALL SELECT 'purchase_order', 0.95 FROM inv WHERE purchase_order <> ''
      UNION ALL SELECT unnest(['vendor', 'payment_instructions']), 0.95 FROM inv WHERE vendor IS NOT NULL) GROUP BY field"""))
def n02(spark, sf):
    # staged: the filter that Spark infers from exploding a column would copy all of its expressions
    n = candidates.stage(fx.normalized(fx.invoices(spark, sf)).select("field_scores"), field_scores=F.col("field_scores"))
    return n.select(F.explode("field_scores").alias("field", "c")).groupBy("field").agg(F.count("*").alias("n"), F.round(F.sum(F.col("c").cast("decimal(6,3)")), 2).alias("total"))


@query("n04_hydrate_context", with_inv("""
    SELECT i.doc_id, m.ap_id IS NOT NULL AS available, m.match_strategy,
      ['none','split_po_partial_billing','amount_variance_within_tolerance','amount_variance_above_tolerance','duplicate_invoice_number_normalized','missing_po_implied_match','vendor_bank_detail_changed','credit_memo_negative_balance'][m.ap_id % 8 + 1] AS scenario
    FROM inv i LEFT JOIN matched m USING (doc_id)""", MATCH))
def n04(spark, sf):
    return match.summarize_context(_hydrated(spark, sf)).select("doc_id", "available", "match_strategy", "scenario")


@query("a15_decision_agreement", with_inv("""
    SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE decision = e) AS matches, COUNT(*) FILTER (WHERE decision <> e) AS mismatches, COUNT(*) FILTER (WHERE e IS NULL) AS missing_expected
    FROM (SELECT decision, ['approve','approve_partial_consumption','approve_with_tolerance','needs_review','flag_possible_duplicate','needs_review','block_or_escalate','apply_credit_or_route_review'][s + 1] AS e FROM final)""", MATCH, DECIDE))
def a15(spark, sf):
    return evaluate.decision_agreement(decide.decide(_hydrated(spark, sf)))


# --- validation ------------------------------------------------------------------------


def _validated(spark, sf):
    inv = fx.invoices(spark, sf)
    # every 9th due date precedes its issue date, every 12th tax is doubled, every 14th
    # subtotal disagrees with its lines, every 15th currency with its amounts
    k = F.col("k")
    p = fx.parsed(inv)
    return (
        p.withColumn("due_date", F.when(k % 9 == 0, F.col("due_date").withField("value", F.lit("1990-01-01"))).otherwise(F.col("due_date")))
        .withColumn("tax", F.when(k % 12 == 0, F.col("tax").withField("amount", F.col("tax.amount") * 2)).otherwise(F.col("tax")))
        .withColumn("item_total", F.when(k % 14 == 0, F.col("item_total") + 9999).otherwise(F.col("item_total")))
        .withColumn("currency", F.when(k % 15 == 0, F.col("currency").withField("value", F.lit("EUR"))).otherwise(F.col("currency")))
    )


_V = {
    "v1_date_order": (0, "CASE WHEN k % 9 = 0 THEN 'fail' ELSE 'pass' END"),
    "v2_amount_composition": (1, "CASE WHEN k % 12 = 0 AND tax > GREATEST(0.02, abs(balance_due) * 0.001) AND tax > 0.02 THEN 'fail' ELSE 'pass' END"),
    "v3_line_item_sum": (2, "CASE WHEN n_lines = 0 THEN 'skipped' WHEN k % 14 = 0 AND 9999 > GREATEST(subtotal * 0.001, n_lines * 0.005 + 0.005) THEN 'fail' ELSE 'pass' END"),
    "v4_currency": (3, "CASE WHEN k % 15 = 0 THEN 'fail' ELSE 'pass' END"),
}
for _n, (_i, _sql) in _V.items():
    def _run(spark, sf, i=_i):
        return validate.with_validations(_validated(spark, sf)).select("doc_id", F.get("validations", i)["status"].alias("status"))

    query(_n, with_inv(f"SELECT doc_id, {_sql} AS status FROM inv"))(_run)


@query("v5_blocking_failures", with_inv(
    f"SELECT doc_id, array_to_string(list_filter([CASE WHEN {_V['v1_date_order'][1]} = 'fail' THEN 'date_order' END, CASE WHEN {_V['v2_amount_composition'][1]} = 'fail' THEN 'amount_composition' END, "
    f"CASE WHEN {_V['v3_line_item_sum'][1]} = 'fail' THEN 'line_item_sum' END, CASE WHEN {_V['v4_currency'][1]} = 'fail' THEN 'currency_consistency' END], lambda x: x IS NOT NULL), ',') AS failures FROM inv"))
def v5(spark, sf):
    return validate.with_validations(_validated(spark, sf)).select("doc_id", joined(F.col("failures")).alias("failures"))


@query("u3_currency_conflicts", with_inv("SELECT doc_id, CASE WHEN k % 15 = 0 THEN 'USD' ELSE '' END AS conflicts FROM inv"))
def u3(spark, sf):
    return _validated(spark, sf).select("doc_id", joined(validate.currency_conflicts(F.col("currency.value"))).alias("conflicts"))


# --- extraction ------------------------------------------------------------------------


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def _kept(spark, sf, name, build) -> DataFrame:
    """An intermediate several queries start from, written once per application and data set."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = materialize(build(), name)
    return _KEPT[key]


def _rendered(spark, sf):
    return _kept(spark, sf, "rendered", lambda: fx.rendered_words(fx.invoices(spark, sf), fx.line_items(spark, sf)))


def _words_once(spark, sf):
    """The words of :func:`_rendered` for one reader: they lie together by page and aren't stored."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fx.rendered_words(fx.invoices(spark, sf), fx.line_items(spark, sf), spread=n)


def _lines(spark, sf):
    return _kept(spark, sf, "rendered-lines", lambda: grid.match_labels(grid.build_lines(_rendered(spark, sf))))


_SCALARS = """
    SELECT doc_id, 'invoice_number' AS field, invoice_number AS value FROM inv UNION ALL SELECT doc_id, 'issue_date', CAST(issue_date AS VARCHAR) FROM inv
    UNION ALL SELECT doc_id, 'due_date', CAST(due_date AS VARCHAR) FROM inv UNION ALL SELECT doc_id, 'terms', 'Net 30' FROM inv
    UNION ALL SELECT doc_id, 'purchase_order', purchase_order FROM inv WHERE purchase_order <> ''"""
_MONEY = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS field, CAST({c} AS DOUBLE) AS amount, 'USD' AS currency FROM inv" for c in ("subtotal", "discount", "tax", "balance_due"))
_PARTIES = "SELECT doc_id, 'seller' AS field, COALESCE(vendor, buyer) AS value FROM inv UNION ALL SELECT doc_id, 'buyer', buyer FROM inv"


@query("x1_extract_scalars", with_inv(_SCALARS))
def x1(spark, sf):
    return fields_.extract_scalars(_lines(spark, sf)).select("doc_id", "field", "value")


@query("x2_extract_money", with_inv(_MONEY))
def x2(spark, sf):
    return fields_.extract_money(_lines(spark, sf)).select("doc_id", "field", "amount", "currency")


@query("x3_extract_parties", with_inv(_PARTIES))
def x3(spark, sf):
    return fields_.extract_parties(_lines(spark, sf)).select("doc_id", "field", "value")


@query("x4_extract_payment", with_inv("SELECT doc_id, 'Acct ' || bank_account AS value FROM inv WHERE bank_account IS NOT NULL"))
def x4(spark, sf):
    return fields_.extract_payment(_lines(spark, sf)).select("doc_id", "value")


@query("x7_extract_currency", with_inv("SELECT doc_id, 'USD' AS value, least(round(0.72 + (n_lines + 4) * 0.03, 3), 0.93)::DOUBLE AS confidence FROM inv"))
def x7(spark, sf):
    return fields_.extract_currency(_lines(spark, sf)).select("doc_id", "value", "confidence")


@query("x5_infer_headers", with_inv("SELECT doc_id, 1 AS page, 'description,quantity,unit_price,amount' AS roles FROM inv WHERE n_lines > 0"))
def x5(spark, sf):
    return tables.infer_headers(_lines(spark, sf)).select("doc_id", "page", joined(F.transform("columns", lambda c: c["role"])).alias("roles"))


@query("x6_extract_line_items", with_inv(
    "SELECT CAST(k AS VARCHAR) AS doc_id, description, CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price, CAST(amount AS DOUBLE) AS amount FROM items", ITEMS))
def x6(spark, sf):
    w, lines = _rendered(spark, sf), _lines(spark, sf)
    return tables.extract_line_items(w, lines, fields_.infer_currency(lines)).select(
        "doc_id", F.col("description.value").alias("description"), F.col("quantity.value").alias("quantity"),
        F.col("unit_price.amount").alias("unit_price"), F.col("amount.amount").alias("amount"),
    )


@query("a08_line_item_sum", with_inv("SELECT doc_id, n_lines AS item_count, CAST(subtotal AS DOUBLE) AS item_sum FROM inv WHERE n_lines > 0"))
def a08(spark, sf):
    items = fx.line_items(spark, sf).select(F.col("k").cast("string").alias("doc_id"), F.struct(F.col("amount").cast("double").alias("amount")).alias("amount"))
    return tables.line_item_sum(items)


def _extraction(spark, sf):
    w = _rendered(spark, sf)
    made: list = []

    def run():
        if not made:
            made.append(extract.extract_invoices(w))
        return made[0]

    fields = _kept(spark, sf, "rendered-fields", lambda: run().fields)
    items = _kept(spark, sf, "rendered-items", lambda: run().items)
    return extract.Extraction(fields, items, _lines(spark, sf)), w


@query("x8_extract_invoices", with_inv(f"""SELECT doc_id, field, value, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS currency FROM (
    {_SCALARS} UNION ALL {_PARTIES} UNION ALL SELECT doc_id, 'currency', 'USD' FROM inv UNION ALL SELECT doc_id, 'payment_instructions', 'Acct ' || bank_account FROM inv WHERE bank_account IS NOT NULL)
    UNION ALL SELECT doc_id, field, NULL, amount, currency FROM ({_MONEY})"""))
def x8(spark, sf):
    """All fields; an amount stands for its text."""
    x, _ = _extraction(spark, sf)
    return x.fields.select("doc_id", "field", F.when(F.col("amount").isNull(), F.col("value")).alias("value"), "amount", "currency")


@query("w13_resolve_balance", with_inv("SELECT doc_id, CAST(balance_due AS DOUBLE) AS amount, 'constraint_resolved:money_label_words' AS method FROM inv"))
def w13(spark, sf):
    x, _ = _extraction(spark, sf)
    return x.fields.filter("field = 'balance_due'").select("doc_id", "amount", "method")


@query("x9_finalize_status", with_inv("""
    SELECT doc_id, CASE WHEN vendor IS NULL OR n_lines < 1 THEN 'needs_review' ELSE 'parsed' END AS status,
      CASE WHEN vendor IS NULL THEN 'low_confidence_or_ambiguous_fields' END AS review_reason, '' AS missing FROM inv"""))
def x9(spark, sf):
    x, w = _extraction(spark, sf)
    return extract.finalize(x, w.select("doc_id")).select("doc_id", "status", "review_reason", joined(F.col("missing_fields")).alias("missing"))


@query("w06_build_lines", with_inv("""
    SELECT doc_id, (14 + CASE WHEN purchase_order <> '' THEN 1 ELSE 0 END + CASE WHEN vendor IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN bank_account IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN n_lines > 0 THEN 1 + n_lines ELSE 0 END - 4)::BIGINT AS lines FROM inv"""))
def w06(spark, sf):
    return grid.build_lines(_words_once(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("w06_document_lines", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, COUNT(*) AS lines FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1""")
def w06_docs(spark, sf):
    return grid.build_lines(fx.doc_words(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("j14_match_labels", with_inv("""
    SELECT label, COUNT(*) AS n FROM (
      SELECT unnest(['invoice no', 'invoice date', 'date', 'due date', 'due', 'date', 'terms', 'bill to', 'to', 'subtotal', 'discount', 'tax', 'balance due', 'due', 'no.']) AS label FROM inv
      UNION ALL SELECT 'purchase order' FROM inv WHERE purchase_order <> '' UNION ALL SELECT 'from' FROM inv WHERE vendor IS NOT NULL
      UNION ALL SELECT unnest(['payment instructions', 'payment']) FROM inv WHERE bank_account IS NOT NULL) GROUP BY label"""))
def j14(spark, sf):
    lines = grid.match_labels(grid.build_lines(_words_once(spark, sf), facts=grid.token_words))
    return lines.select(F.explode("hits").alias("h")).groupBy(F.col("h.label").alias("label")).agg(F.count("*").alias("n"))


@query("j15_drop_shadowed", with_inv("""
    SELECT label, COUNT(*) AS n FROM (
      SELECT unnest(['invoice no', 'invoice date', 'date', 'due date', 'date', 'terms', 'bill to', 'to', 'subtotal', 'discount', 'tax', 'balance due', 'due', 'no.']) AS label FROM inv
      UNION ALL SELECT 'purchase order' FROM inv WHERE purchase_order <> '' UNION ALL SELECT 'from' FROM inv WHERE vendor IS NOT NULL
      UNION ALL SELECT 'payment instructions' FROM inv WHERE bank_account IS NOT NULL) GROUP BY label"""))
def j15(spark, sf):
    return _lines(spark, sf).select(F.explode(grid.drop_shadowed(F.col("hits"))).alias("h")).groupBy(F.col("h.label").alias("label")).agg(F.count("*").alias("n"))


@query("j16_assign_cells")
def j16(spark, sf):
    w = _rendered(spark, sf)
    h = tables.infer_headers(_lines(spark, sf)).withColumn("carried", F.lit(False))
    return tables.table_rows(w, h).select("doc_id", "line_no", F.explode("cells").alias("c")).select("doc_id", "line_no", F.col("c.role").alias("role"), grid.words_text(F.col("c.words")).alias("text"))


@query("w09_continue_headers", with_inv("SELECT doc_id, CAST(p AS INT) AS page, p > 1 AS carried FROM (SELECT doc_id, unnest(range(1, greatest(CAST(ceil(n_lines / 20) AS BIGINT), 1) + 1)) AS p FROM inv WHERE n_lines > 0)"))
def w09(spark, sf):
    w = _rendered(spark, sf)
    return tables.continue_headers(tables.infer_headers(_lines(spark, sf)), w).select("doc_id", "page", "carried")


@query("x10_evidence_boxes")
def x10(spark, sf):
    x, w = _extraction(spark, sf)
    return merge.evidence_boxes(x.fields, x.items, w, "all").groupBy("source").agg(F.count("*").alias("n"))


@query("x14_empty_results", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'no_text_layer' AS status FROM documents WHERE trim(replace(text, chr(10), '')) = ''")
def x14(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    return extract.empty_results(docs, fx.doc_words(spark, sf).select("doc_id")).select("doc_id", "status")


# --- profiles --------------------------------------------------------------------------

_TOKENS = """
pg AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(floor((n - 1) / 60) + 1 AS INT) AS page, line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
wd AS (SELECT doc_id, page, unnest(string_split(line, ' ')) AS w FROM pg),
facts AS (SELECT doc_id, page, COUNT(*) FILTER (WHERE trim(w) <> '') AS word_count, SUM(length(trim(w))) AS visible FROM wd GROUP BY 1, 2),
chars AS (SELECT doc_id, page, SUM(length(line)) AS chars FROM pg GROUP BY 1, 2)"""


@query("a05_profile_pages", f"""WITH {_TOKENS} SELECT doc_id, page, word_count, CAST(visible AS BIGINT) AS visible_char_count,
    chars = 0 OR visible < 8 OR word_count < 3 AS unusable FROM facts JOIN chars USING (doc_id, page)""")
def a05(spark, sf):
    p = profile.profile_pages(fx.doc_words(spark, sf), fx.doc_pages(spark, sf))
    return p.select("doc_id", "page", "word_count", "visible_char_count", (F.col("route") == "local_ocr").alias("unusable"))


@query("a06_document_route", f"""WITH {_TOKENS},
    r AS (SELECT doc_id, CASE WHEN chars = 0 OR visible < 8 OR word_count < 3 THEN 'local_ocr' WHEN word_count < 20 THEN 'hybrid' ELSE 'native_text' END AS route FROM facts JOIN chars USING (doc_id, page)),
    d AS (SELECT CASE WHEN bool_and(route = 'native_text') THEN 'native_text' WHEN bool_and(route = 'local_ocr') THEN 'local_ocr' ELSE 'hybrid' END AS route FROM r GROUP BY doc_id)
    SELECT route, COUNT(*) AS n FROM d GROUP BY route""")
def a06(spark, sf):
    p = profile.profile_pages(fx.doc_words(spark, sf), fx.doc_pages(spark, sf))
    return evaluate.value_counts(profile.document_route(p), "route")


@query("a07_no_text_layer", f"""WITH {_TOKENS} SELECT doc_id, CAST(SUM(word_count) AS BIGINT) AS words, CAST(SUM(visible) AS BIGINT) AS visible,
    SUM(visible) < 8 OR SUM(word_count) < 3 AS no_text_layer FROM facts GROUP BY doc_id HAVING SUM(word_count) > 0""")
def a07(spark, sf):
    return profile.document_text_layer(fx.doc_words(spark, sf))


@query("f39_document_text", with_inv("SELECT doc_id, 1 AS page, '--- Page 1 ---' || chr(10) || 'Invoice ' || invoice_number AS text FROM inv"))
def f39(spark, sf):
    pages = fx.invoices(spark, sf).select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("Invoice "), "invoice_number").alias("text"))
    return profile.document_text(pages)


def _says(phrases) -> str:
    """SQL: the lower-case page text ``low`` holds one of the phrases."""
    return "(" + " OR ".join("contains(low, '{}')".format(p.lower().replace("'", "''")) for p in phrases) + ")"


_PAGE_TEXTS = """pages AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(floor((n - 1) / 60) + 1 AS INT) AS page, lower(string_agg(line, chr(10) ORDER BY n)) AS low FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) GROUP BY 1, 2),
ends AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM pages GROUP BY 1)"""
_SOUGHT = ("tax", "terms", "due_date", "line_items")


@query("p22_pages_mention", f"WITH {_PAGE_TEXTS} " + " UNION ".join(
    f"SELECT doc_id, '{k}' AS field FROM pages WHERE {_says(lx.LINE_ITEM_MENTIONS if k == 'line_items' else lx.FIELD_LABELS.get(k, (k.replace('_', ' '),)))}" for k in (*lx.FIELD_KEYS, "line_items")))
def p22(spark, sf):
    return grid.pages_mention(fx.doc_page_texts(spark, sf))


@query("w11_important_pages", f"""WITH {_PAGE_TEXTS} SELECT doc_id, page, ROW_NUMBER() OVER (PARTITION BY doc_id
    ORDER BY CASE WHEN {_says((*lx.FIELD_LABELS["tax"], *lx.FIELD_LABELS["due_date"]))} THEN 0 WHEN page = a THEN 1 WHEN page = b THEN 2 ELSE 3 END, page) AS position FROM pages JOIN ends USING (doc_id)""")
def w11(spark, sf):
    pages = fx.doc_page_texts(spark, sf)
    targets = pages.select("doc_id").distinct().withColumn("targets", F.array(F.lit("tax"), F.lit("due_date")))
    return profile.important_pages(pages, targets).select("doc_id", "page", "position")


@query("w05_likely_region", f"WITH {_PAGE_TEXTS} " + " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS field, COALESCE({'max' if k in lx.BOTTOM_FIELDS else 'min'}(page) FILTER (WHERE {_says(lx.REGION_HINTS.get(k, (k.replace('_', ' '),)))}), {'max' if k in lx.BOTTOM_FIELDS else 'min'}(page)) AS page, "
    f"{316.8 if k in lx.BOTTOM_FIELDS else 95.04 if k == 'line_items' else 0.0} AS top FROM pages GROUP BY doc_id" for k in _SOUGHT))
def w05(spark, sf):
    pages = fx.doc_page_texts(spark, sf)
    targets = pages.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, _SOUGHT))).alias("field"))
    return profile.likely_region(targets, pages).select("doc_id", "field", "page", F.round(F.get("bbox", 1), 2).alias("top"))


# --- scalar functions ------------------------------------------------------------------


def _on(table_name: str, key: str, **cols):
    def run(spark, sf):
        return fx.table(spark, sf, table_name).select(key, *[fn().alias(n) for n, fn in cols.items()])

    return run


c = F.col
query("f01_invoice_number", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, 'X' || printf('%05d', o_orderkey) AS b FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.normalize_invoice_number(F.concat(F.lit("Invoice No. INV-"), F.format_string("%08d", "o_orderkey"))),
        b=lambda: text.normalize_invoice_number(F.concat(F.lit("inv x-"), F.format_string("%05d", "o_orderkey")))))
query("f02_purchase_order", "SELECT o_orderkey, 'PO' || o_orderkey AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.normalize_purchase_order(F.concat(F.lit("po # "), c("o_orderkey").cast("string")))))
query("f03_vendor_name", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS a FROM supplier")(
    _on("supplier", "s_suppkey", a=lambda: text.normalize_vendor_name(F.concat("s_name", F.lit(", Inc. Co")))))
query("f04_money_decimal", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS a FROM lineitem")(
    lambda spark, sf: fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money.money_decimal(F.format_string("%.2f", "l_extendedprice")).alias("a")))
query("f05_party_ids", "SELECT s_suppkey, 'US' || printf('%09d', s_suppkey) AS tax, 'V' || printf('%05d', s_suppkey) AS vendor FROM supplier")(
    _on("supplier", "s_suppkey",
        tax=lambda: joined(text.extract_tax_ids(F.concat("s_name", F.lit("\nTax ID: US-"), F.format_string("%09d", "s_suppkey")))),
        vendor=lambda: joined(text.extract_vendor_ids(F.concat(F.lit("Vendor No. V-"), F.format_string("%05d", "s_suppkey"))))))
query("f06_bank_and_email", "SELECT s_suppkey, '**** ' || right(printf('%08d', s_suppkey), 4) AS account, 'ap' || s_suppkey || '@x.example' AS email FROM supplier")(
    _on("supplier", "s_suppkey",
        account=lambda: text.extract_bank_account(F.concat(F.lit("Account no "), F.format_string("%08d", "s_suppkey"))),
        email=lambda: text.extract_email(F.concat(F.lit("pay ap"), c("s_suppkey").cast("string"), F.lit("@x.example now")))))
query("f07_mask_account", "SELECT o_orderkey, '**** ' || right(CAST(o_orderkey AS VARCHAR), 4) AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.mask_account(F.concat(F.lit("acct-"), c("o_orderkey").cast("string")))))
query("f08_tax_identifier", "SELECT s_suppkey, printf('%07d', s_suppkey) AS a FROM supplier")(
    _on("supplier", "s_suppkey", a=lambda: text.normalize_tax_identifier(F.concat(F.lit("vat GB "), F.format_string("%07d", "s_suppkey")))))
query("f09_first_line", "SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS a FROM conversations")(
    lambda spark, sf: fx.table(spark, sf, "conversations").select("conv_id", "turn", text.first_party_line(c("text")).alias("a")))
query("f10_money_mentions", "SELECT o_orderkey, o_totalprice AS amount, 'USD' AS currency FROM orders")(
    lambda spark, sf: fx.table(spark, sf, "orders").select("o_orderkey", F.explode(money.money_mentions(F.concat(F.lit("Total USD "), F.format_number("o_totalprice", 2)))).alias("m")).select("o_orderkey", "m.amount", "m.currency"))
query("f11_parse_amount", "SELECT o_orderkey, -o_totalprice AS a, o_totalprice AS b FROM orders")(
    _on("orders", "o_orderkey", a=lambda: money.parse_amount(F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")"))),
        b=lambda: money.parse_amount(F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))))
query("f12_currency", "SELECT o_orderkey, ['USD', 'INR', 'EUR', 'CNY', NULL][o_orderkey % 5 + 1] AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: money.normalize_currency(F.get(F.array(*[F.lit(x) for x in ("usd", "Rs.", "€", "RMB", "¥")]), (c("o_orderkey") % 5).cast("int")))))
query("f13_currency_for_money", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: money.currency_for_money(F.struct(F.when(c("o_orderkey") % 3 == 2, "¥ 5").otherwise("5").alias("raw"), F.when(c("o_orderkey") % 3 == 0, "EUR").alias("currency")), F.lit("USD"))))
query("f14_parse_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS a, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS b, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS c FROM orders")(
    _on("orders", "o_orderkey", a=lambda: dates.parse_date(F.date_format("o_orderdate", "d MMMM yyyy"))["value"],
        b=lambda: dates.parse_date(F.concat(F.lit("on "), F.date_format("o_orderdate", "MM/dd/yyyy")))["value"], c=lambda: dates.parse_date(F.date_format("o_orderdate", "yyyyMMdd"))["value"]))
query("f15_possible_dates", "SELECT o_orderkey, CASE WHEN day(o_orderdate) IN (19, 20) THEN 0 WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 2 ELSE 1 END AS n FROM orders")(
    _on("orders", "o_orderkey", n=lambda: F.size(dates.possible_dates(F.date_format("o_orderdate", "dd/MM/yyyy")))))
query("f16_date_candidates", "SELECT o_orderkey, true AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: F.array_contains(dates.date_candidates(F.lit("x"), F.date_format("o_orderdate", "dd.MM.yyyy")), F.date_format("o_orderdate", "yyyy-MM-dd"))))
query("f17_normalize_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d %m') END AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: dates.normalize_date(F.when(c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("o_orderdate", "dd MM")))))
query("f18_identifier_value", "SELECT o_orderkey, 'PO-' || o_orderkey AS a, NULL AS b FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.identifier_value(F.concat(F.lit(" PO "), c("o_orderkey").cast("string"), F.lit("."))), b=lambda: text.identifier_value(F.concat(F.lit("seen on "), c("o_orderkey").cast("string")))))
query("f19_clean_raw", "SELECT o_orderkey, 'a ' || o_orderkey || ' b' AS a, 'INV-' || o_orderkey AS b FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.clean_raw(F.concat(F.lit(" : a  "), c("o_orderkey").cast("string"), F.lit("\t b :"))), b=lambda: text.strip_leading_label("invoice_number", F.concat(F.lit("Invoice No: INV-"), c("o_orderkey").cast("string")))))
query("f20_quantity", "SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity AS b FROM lineitem")(
    lambda spark, sf: fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.quantity_token(F.format_string("%.1f", "l_quantity")).alias("a"), text.quantity_from_text(F.concat(F.lit("in 2024 about "), F.format_string("%.1f", "l_quantity"))).alias("b")))
query("f21_clean_description", "SELECT p_partkey, p_name AS a FROM part")(
    _on("part", "p_partkey", a=lambda: text.clean_description(F.concat(F.lit("- "), F.regexp_replace("p_name", " ", "   "), F.lit(" USD $ :")))))
query("f22_looks_like", "SELECT p_partkey, p_partkey % 2 = 0 AS a, true AS b FROM part")(
    _on("part", "p_partkey", a=lambda: text.looks_like_non_item(F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("Sub-total "), "p_name")).otherwise(c("p_name"))), b=lambda: text.looks_like_invoice_number(F.concat(F.lit("#"), c("p_partkey").cast("string")))))
query("f23_canonical", "SELECT p_partkey, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]+', '', 'g') AS a FROM part")(
    _on("part", "p_partkey", a=lambda: text.canonical(F.concat("p_name", F.lit("-"), "p_brand"))))
query("f24_confidence", "SELECT o_orderkey, CASE WHEN o_orderkey % 200 > 100 THEN o_orderkey % 200 WHEN o_orderkey % 200 > 1 THEN (o_orderkey % 200) / 100 ELSE o_orderkey % 200 END::DOUBLE AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.clamp_confidence((c("o_orderkey") % 200).cast("string"))))
query("f25_display_increment", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 ELSE 0.01 END::DOUBLE AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.display_increment(F.when(c("o_orderkey") % 3 == 0, "USD 12").when(c("o_orderkey") % 3 == 1, "12.5").otherwise("(12,50)"))))
query("f26_fingerprint", f"SELECT o_orderkey, left(sha256('{lx.PIPELINE_VERSION}:{{\"n\":' || o_orderkey || '}}'), 16) AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.config_fingerprint(F.concat(F.lit('{"n":'), c("o_orderkey").cast("string"), F.lit("}")))))
query("f27_parser_method", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'ai' WHEN o_orderkey % 3 = 0 THEN 'hybrid' WHEN o_orderkey % 2 = 0 THEN 'local_ocr' ELSE 'native_text' END AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: text.parser_method(c("o_orderkey") % 5 == 0, F.lit(True), F.when(c("o_orderkey") % 3 == 0, "hybrid"), c("o_orderkey") % 2 == 0)))
query("f28_money_equal", "SELECT o_orderkey, o_orderkey % 2 = 0 AS a, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS b FROM orders")(
    _on("orders", "o_orderkey", a=lambda: money.money_equal(F.format_string("%.2f", "o_totalprice"), c("o_totalprice") + F.when(c("o_orderkey") % 2 == 0, 0.0).otherwise(0.01)), b=lambda: money.money_key(F.format_string("%.2f", "o_totalprice"))))
query("f29_amount_display", "SELECT o_orderkey, 'USD ' || format('{:,.2f}', o_totalprice) AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: money.amount_display(F.format_string("%.2f", "o_totalprice"), F.lit("USD"))))
query("f30_keys", "SELECT o_orderkey, 'gmail-message:' || o_custkey || ':m' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ':reprocess:r' ELSE '' END AS a, 'm' || o_orderkey AS b FROM orders")(
    _on("orders", "o_orderkey", a=lambda: keys.message_work_key(F.lit("gmail"), c("o_custkey"), F.concat(F.lit("m"), c("o_orderkey").cast("string")), F.when(c("o_orderkey") % 2 == 0, "r")),
        b=lambda: keys.message_id_from_resource(F.concat(F.lit("users/1/messages/'m"), c("o_orderkey").cast("string"), F.lit("'")))))
query("f33_received_at", "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS a FROM events")(
    _on("events", "event_id", a=lambda: dates.received_at(F.when(c("event_id") % 2 == 0, (F.unix_seconds(c("ts").cast("timestamp")) * 1000).cast("string")), F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0000'")).cast("timestamp_ntz")))
query("f34_header_value", "SELECT conv_id, turn, role AS a FROM conversations")(
    lambda spark, sf: fx.table(spark, sf, "conversations").select("conv_id", "turn", keys.header_value(F.array(F.struct(F.lit("Subject").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("FROM").alias("name"), c("role").alias("value"))), "from").alias("a")))
query("f35_filename_patterns", r"SELECT '^invoice[\s._:#-]*\d+[\s._:#-]*\d+(?:\.pdf)?$' AS pattern, COUNT(*) AS n FROM orders")(
    lambda spark, sf: fx.table(spark, sf, "orders").select(text.filename_pattern(F.concat(F.lit("invoice_"), c("o_custkey").cast("string"), F.lit("-"), c("o_orderkey").cast("string"), F.lit(".pdf"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")))
query("f37_text_similarity")(
    lambda spark, sf: fx.table(spark, sf, "part").select("p_partkey", F.round(match.text_similarity(c("p_name"), c("p_brand")), 6).alias("a")))
query("f38_boxes", "SELECT l_orderkey, l_linenumber, greatest(0, l_quantity - l_quantity * 0.1) AS x0, least(100, l_quantity * 2 + l_quantity * 0.1) AS x1 FROM lineitem")(
    lambda spark, sf: fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", boxes.pad_box(F.array(c("l_quantity"), F.lit(0.0), c("l_quantity") * 2, F.lit(5.0)), 0.1, F.lit(100.0), F.lit(50.0)).alias("b")).select("l_orderkey", "l_linenumber", F.col("b")[0].alias("x0"), F.col("b")[2].alias("x1")))
query("f40_money_parts", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS value, 'v' AS shown FROM orders")(
    lambda spark, sf: fx.table(spark, sf, "orders").select("o_orderkey", truth.money_parts(F.struct(F.format_string("%.2f", "o_totalprice").alias("value"), F.lit("v").alias("visible_value"), F.lit("d").alias("display"))).alias("m")).select("o_orderkey", "m.value", F.col("m.visible_value").alias("shown")))
query("f41_visible_money", "SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(12,1)) AS VARCHAR) AS a FROM orders")(
    _on("orders", "o_orderkey", a=lambda: money.visible_money(F.format_string("%.2f", "o_totalprice"), F.lit(1))))
query("p01_json", "SELECT event_id, props AS a, '[]' AS b FROM events")(
    _on("events", "event_id", a=lambda: F.regexp_replace(keys.json_obj(c("props")), ":", ": "), b=lambda: keys.json_arr(c("props"))))
query("p11_is_pdf", "SELECT conv_id, turn, turn % 2 = 0 AS a FROM conversations")(
    lambda spark, sf: fx.messages(spark, sf).select(c("account_id").alias("conv_id"), F.substring_index("message_id", "-", -1).cast("long").alias("turn"), mail.is_pdf_attachment(F.lit(None), c("filename")).alias("a")))
query("p27_word_tests", "SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS cur, true AS num FROM lineitem")(
    lambda spark, sf: fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.is_currency_word(F.when(c("l_linenumber") % 2 == 0, "usd.").otherwise("usdx")).alias("cur"), text.is_number_word(F.format_number("l_extendedprice", 2)).alias("num")))
query("p28_line_tests", "SELECT p_partkey, p_partkey % 2 = 0 AS a FROM part")(
    _on("part", "p_partkey", a=lambda: text.has_table_header_text(F.when(c("p_partkey") % 2 == 0, "Item Qty Amount").otherwise(F.lit("Item Qty")))))


# --- stored tables: queues, upserts, work ----------------------------------------------


def _st(spark, sf, *names):
    return [stored.view(spark, sf, n) for n in names]


_QUEUE = ("extractions", "decisions", "attachments", "messages")
_Q_SQL = """SELECT e.pdf_file_id, e.attachment_id, e.vendor_name AS vendor, e.invoice_number, d.decision, m.received_at, a.filename, m.sender
    FROM extractions e LEFT JOIN decisions d USING (owner_user_id, pdf_file_id) LEFT JOIN attachments a ON a.id = e.attachment_id LEFT JOIN messages m ON m.id = a.message_id"""


@query("j01_list_invoices", stored.cte(*_QUEUE) + _Q_SQL)
def j01(spark, sf):
    return queue.list_invoices(*_st(spark, sf, *_QUEUE)).select("pdf_file_id", "attachment_id", "vendor", "invoice_number", "decision", "received_at", "filename", "sender")


@query("t01_page_rows", stored.cte(*_QUEUE) + "SELECT e.pdf_file_id, d.decision FROM extractions e LEFT JOIN decisions d USING (owner_user_id, pdf_file_id) LEFT JOIN attachments a ON a.id = e.attachment_id LEFT JOIN messages m ON m.id = a.message_id WHERE e.owner_user_id = 'NATION_3' ORDER BY COALESCE(m.received_at, e.updated_at) DESC, e.updated_at DESC, e.pdf_file_id DESC LIMIT 20 OFFSET 5")
def t01(spark, sf):
    return queue.list_invoices(*_st(spark, sf, *_QUEUE), owner="NATION_3", limit=20, offset=5).select("pdf_file_id", "decision")


@query("p02_queue_row", stored.cte(*_QUEUE) + "SELECT e.pdf_file_id, CAST(e.amount_due AS VARCHAR) AS amount_due, d.confidence, m.subject FROM extractions e LEFT JOIN decisions d USING (owner_user_id, pdf_file_id) LEFT JOIN attachments a ON a.id = e.attachment_id LEFT JOIN messages m ON m.id = a.message_id")
def p02(spark, sf):
    return queue.queue_row(queue.list_invoices(*_st(spark, sf, *_QUEUE))).select("pdf_file_id", "amount_due", "confidence", "subject")


_WIDE = ("extractions", "files", "parses", "decisions", "attachments", "messages")
_W_JOIN = """FROM extractions e JOIN files f ON f.id = e.pdf_file_id LEFT JOIN parses p ON p.pdf_file_id = e.pdf_file_id
    LEFT JOIN decisions d ON d.owner_user_id = e.owner_user_id AND d.pdf_file_id = e.pdf_file_id LEFT JOIN attachments a ON a.id = e.attachment_id LEFT JOIN messages m ON m.id = a.message_id"""


@query("j02_invoice_wide", stored.cte(*_WIDE) + f"SELECT e.pdf_file_id, f.sha256, p.status AS raw_parse_status, d.decision_summary, a.candidate_reason, m.subject {_W_JOIN}".replace("d.decision_summary", "d.summary AS decision_summary"))
def j02(spark, sf):
    return queue.invoice_wide(*_st(spark, sf, *_WIDE)).select("pdf_file_id", "sha256", "raw_parse_status", "decision_summary", "candidate_reason", "subject")


@query("p04_invoice_detail", stored.cte(*_WIDE) + f"SELECT e.pdf_file_id, m.subject, f.byte_size, COALESCE(p.status, e.parse_status) AS status, d.next_action {_W_JOIN}")
def p04(spark, sf):
    return queue.invoice_detail(queue.invoice_wide(*_st(spark, sf, *_WIDE))).select("pdf_file_id", c("message.subject").alias("subject"), c("pdf.byte_size").alias("byte_size"), c("raw_parse.status").alias("status"), c("decision.next_action").alias("next_action"))


_REVIEW = "d.decision IS NULL OR d.decision IN ('needs_review','request_missing_info','flag_possible_duplicate','block_or_escalate','apply_credit_or_route_review')"


@query("j03_review_queue", stored.cte(*_WIDE, "accounts") + f"SELECT e.pdf_file_id, d.decision, x.email AS account_email {_W_JOIN} LEFT JOIN accounts x ON x.id = a.account_id WHERE {_REVIEW}")
def j03(spark, sf):
    return queue.review_queue(*_st(spark, sf, *_WIDE, "accounts")).select("pdf_file_id", "decision", "account_email")


@query("t02_review_page", stored.cte(*_WIDE) + f"SELECT e.pdf_file_id, d.decision {_W_JOIN} WHERE e.owner_user_id = 'NATION_3' AND ({_REVIEW}) ORDER BY COALESCE(m.received_at, e.updated_at) DESC, e.updated_at DESC, e.pdf_file_id DESC LIMIT 50")
def t02(spark, sf):
    return queue.review_page(queue.review_queue(*_st(spark, sf, *_WIDE, "accounts"), owner="NATION_3")).select("pdf_file_id", "decision")


@query("p03_review_item", stored.cte(*_WIDE) + f"SELECT e.pdf_file_id, COALESCE(e.invoice_number, json_extract_string(p.result, '$.fields.invoice_number.value'), a.filename, '') AS invoice_number, 'USD ' || format('{{:,.2f}}', CAST(e.amount_due AS DOUBLE)) AS amount {_W_JOIN} WHERE {_REVIEW}")
def p03(spark, sf):
    return queue.review_item(queue.review_queue(*_st(spark, sf, *_WIDE, "accounts"))).select("pdf_file_id", "invoice_number", "amount")


@query("p05_for_owner", stored.cte("extractions") + "SELECT pdf_file_id FROM extractions WHERE owner_user_id = 'NATION_7'")
def p05(spark, sf):
    return queue.for_owner(*_st(spark, sf, "extractions"), "NATION_7").select("pdf_file_id")


@query("p06_needs_review", stored.cte("decisions") + "SELECT pdf_file_id, decision NOT LIKE 'approve%' AS a FROM decisions")
def p06(spark, sf):
    return _st(spark, sf, "decisions")[0].select("pdf_file_id", queue.needs_review(c("decision")).alias("a"))


@query("p07_received_between", stored.cte("messages") + "SELECT id FROM messages WHERE CAST(received_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def p07(spark, sf):
    return queue.received_between(*_st(spark, sf, "messages"), "received_at", "1996-01-01", "1997-06-30").select("id")


@query("a01_count_invoices", stored.cte("extractions") + "SELECT owner_user_id, COUNT(*) AS invoice_count FROM extractions GROUP BY 1")
def a01(spark, sf):
    return queue.count_invoices(*_st(spark, sf, "extractions"))


_OWNED = "FROM attachments a JOIN accounts x ON x.id = a.account_id JOIN files f ON f.id = a.pdf_file_id"
_NOT_LIVE = "NOT EXISTS (SELECT 1 FROM jobs j WHERE j.type = 'parse_pdf' AND CAST(json_extract_string(j.payload, '$.pdf_file_id') AS BIGINT) = a.pdf_file_id AND j.status IN ('pending','running','retry'))"


@query("j05_latest_attachment", stored.cte("files", "attachments", "accounts") + f"SELECT owner_user_id, pdf_file_id, attachment_id FROM (SELECT x.owner_user_id, a.pdf_file_id, a.id AS attachment_id, ROW_NUMBER() OVER (PARTITION BY x.owner_user_id, a.pdf_file_id ORDER BY a.created_at DESC, a.id DESC) rn {_OWNED}) WHERE rn = 1")
def j05(spark, sf):
    return queue.latest_attachment(*_st(spark, sf, "files", "attachments", "accounts")).select("owner_user_id", "pdf_file_id", "attachment_id")


@query("j06_stale_parses", stored.cte("attachments", "accounts", "files", "parses", "jobs") + f"SELECT a.id AS attachment_id, 'parse-pdf:' || a.id || ':rev2' AS unique_key {_OWNED} LEFT JOIN parses p ON p.pdf_file_id = a.pdf_file_id WHERE p.parser_version IS DISTINCT FROM 'rev2' AND {_NOT_LIVE}")
def j06(spark, sf):
    return queue.stale_parses(*_st(spark, sf, "attachments", "accounts", "files", "parses", "jobs"), "rev2").select("attachment_id", "unique_key")


_ELIG = "p.status = 'needs_review' AND (p.pdf_file_id % 7 = 0 OR p.pdf_file_id % 11 = 0 OR p.pdf_file_id % 13 = 0)"


@query("j07_second_pass", stored.cte("attachments", "accounts", "files", "parses", "jobs") + f"SELECT pdf_file_id, attachment_id FROM (SELECT a.pdf_file_id, a.id AS attachment_id, ROW_NUMBER() OVER (PARTITION BY a.pdf_file_id ORDER BY a.created_at, a.id) rn {_OWNED} JOIN parses p ON p.pdf_file_id = a.pdf_file_id WHERE {_ELIG} AND {_NOT_LIVE}) WHERE rn = 1")
def j07(spark, sf):
    return queue.second_pass_candidates(*_st(spark, sf, "attachments", "accounts", "files", "parses", "jobs"), "k1").select("pdf_file_id", "attachment_id")


@query("p17_second_pass_eligible", stored.cte("parses") + f"SELECT pdf_file_id FROM parses p WHERE {_ELIG}")
def p17(spark, sf):
    p = _st(spark, sf, "parses")[0]
    arr = lambda path: F.from_json(F.get_json_object("result", path), "array<string>")
    return p.filter(merge.second_pass_eligible(c("status"), F.get_json_object("result", "$.ocr_used") == "true", arr("$.ocr_failed_parts"), arr("$.warnings"))).select("pdf_file_id")


def _halves(spark, sf):
    o = fx.table(spark, sf, "orders").select(c("o_custkey").alias("id"), c("o_orderdate").cast("timestamp").alias("at"), c("o_orderkey").alias("v"), F.when(c("o_orderkey") % 3 != 0, c("o_orderstatus")).alias("s"))
    base = o.filter("v % 2 = 0").groupBy("id").agg(F.max_by(F.struct("at", "v", "s"), "v").alias("r")).select("id", "r.*")
    return base, o.filter("v % 2 = 1")


_HALVES = """WITH o AS (SELECT o_custkey AS id, CAST(o_orderdate AS TIMESTAMP) AS at, o_orderkey AS v, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS s FROM orders),
    t AS (SELECT id, v, s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY v DESC) rn FROM o WHERE v % 2 = 0) WHERE rn = 1),
    u AS (SELECT id, v, s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY v DESC) rn FROM o WHERE v % 2 = 1) WHERE rn = 1)"""


@query("s06_upsert_latest", _HALVES + "SELECT id, COALESCE(u.v, t.v) AS v, CASE WHEN u.id IS NOT NULL THEN u.s ELSE t.s END AS s FROM t FULL JOIN u USING (id)")
def s06(spark, sf):
    base, upd = _halves(spark, sf)
    return sinks.upsert_latest(base, upd, ["id"], "v").select("id", "v", "s")


def _newest(upd):
    return upd.groupBy("id").agg(F.max_by(F.struct("at", "v", "s"), "v").alias("r")).select("id", "r.*")


@query("s07_upsert_coalesce", _HALVES + "SELECT id, COALESCE(u.v, t.v) AS v, COALESCE(u.s, t.s) AS s FROM t FULL JOIN u USING (id)")
def s07(spark, sf):
    base, upd = _halves(spark, sf)
    return sinks.upsert_coalesce(base, _newest(upd), ["id"], ["s"]).select("id", "v", "s")


@query("s08_upsert_columns", _HALVES + "SELECT id, COALESCE(u.v, t.v) AS v, CASE WHEN t.id IS NOT NULL THEN t.s ELSE u.s END AS s FROM t FULL JOIN u USING (id)")
def s08(spark, sf):
    base, upd = _halves(spark, sf)
    return sinks.upsert_columns(base, _newest(upd), ["id"], ["v"]).select("id", "v", "s")


@query("s03_content_ledger", "SELECT sha256(text) AS sha256, octet_length(encode(any_value(text))) AS byte_size, COUNT(*) AS copies FROM documents GROUP BY 1")
def s03(spark, sf):
    files = fx.table(spark, sf, "documents").select(F.encode("text", "utf-8").alias("content"), c("doc_id").cast("string").alias("filename"))
    return readers.content_ledger(files).select("sha256", "byte_size", "copies")


@query("s11_audit_rows", with_inv("SELECT doc_id, decision FROM final", MATCH, DECIDE))
def s11(spark, sf):
    h = _hydrated(spark, sf)
    d = decide.decide(h)
    rows = sinks.audit_rows(context=match.summarize_context(h), decision=d.select("doc_id", "decision", "confidence", "summary"))
    return rows.select("doc_id", F.get_json_object("audit", "$.decision.decision").alias("decision"))


@query("a03_backfill_keys", stored.cte("jobs", "known_keys") + """,
    n AS (SELECT unique_key, MAX(type) AS type, MIN(created_at) AS a, MAX(updated_at) AS b FROM jobs WHERE status = 'completed' AND type = 'parse_pdf' GROUP BY 1)
    SELECT unique_key, LEAST(k.first_seen_at, n.a) AS first_seen_at, COALESCE(k.completed_at, n.b) AS completed_at, GREATEST(k.updated_at, n.b) AS updated_at
    FROM known_keys k FULL JOIN n USING (unique_key)""")
def a03(spark, sf):
    return sinks.backfill_keys(*_st(spark, sf, "jobs", "known_keys"), lx.DURABLE_WORK_TYPES).drop("type")


@query("a26_assert_unique", "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def a26(spark, sf):
    return sinks.assert_unique(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("w03_first_per", "SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders) WHERE rn = 1")
def w03(spark, sf):
    return candidates.first_per(fx.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("t03_top_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn <= 5")
def t03(spark, sf):
    return candidates.top_per_key(fx.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5).select("o_custkey", "o_orderkey")


# --- events ----------------------------------------------------------------------------

_EV = """WITH ev AS (SELECT event_id AS id, 'gmail' AS provider, CASE WHEN user_id % 9 <> 0 THEN user_id END AS account_id,
    event_type || ':' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS event_key, event_type FROM events)"""


@query("st1_first_events", _EV + "SELECT account_id, event_key, MIN(id) AS id FROM ev GROUP BY account_id, event_key")
def st1(spark, sf):
    return events.first_events(fx.events_in(spark, sf)).select("account_id", "event_key", "id")


@query("u2_dedupe_unknown", _EV + "SELECT id FROM ev WHERE account_id IS NOT NULL UNION ALL SELECT MIN(id) FROM ev WHERE account_id IS NULL GROUP BY event_key")
def u2(spark, sf):
    return events.dedupe_unknown_events(fx.events_in(spark, sf)).select("id")


def _work(spark, sf):
    return fx.events_in(spark, sf).select(
        F.concat("event_key", F.lit(":"), F.coalesce(c("account_id").cast("string"), F.lit("?"))).alias("unique_key"), c("id").alias("seq"),
        F.when(c("event_type") == "click", "parse_pdf").otherwise("gmail_history_sync").alias("type"),
    )


@query("st2_admit_work", _EV + """, w AS (SELECT event_key || ':' || COALESCE(CAST(account_id AS VARCHAR), '?') AS unique_key, id AS seq, CASE WHEN event_type = 'click' THEN 'parse_pdf' ELSE 'gmail_history_sync' END AS type FROM ev)
    SELECT unique_key, MIN(seq) AS seq, MIN(type) AS type FROM w WHERE NOT (type = 'parse_pdf' AND unique_key IN (SELECT unique_key FROM w WHERE seq % 5 = 0)) AND unique_key NOT IN (SELECT unique_key FROM w WHERE seq % 7 = 0) GROUP BY unique_key""")
def st2(spark, sf):
    w = _work(spark, sf)
    return events.admit_work(w, w.filter("seq % 5 = 0").select("unique_key").distinct(), w.filter("seq % 7 = 0").select("unique_key").distinct()).select("unique_key", "seq", "type")


def _batches(spark, df, order, n=3):
    """``df`` in ``n`` slices of growing ``order``, as it would arrive."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    step = ((hi or 0) - (lo or 0)) // n + 1
    return [df.filter((c(order) >= (lo or 0) + k * step) & (c(order) < (lo or 0) + (k + 1) * step)) for k in range(n)]


def _streamed(spark, batches, operator):
    """Rows that ``operator`` gives of a stream on which the batches arrive one by one, with a restart each time."""
    at = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    for rows in batches:
        rows.write.mode("append").parquet(f"{at}/in")
        state.run_to_end(operator(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query("st1_first_events_by_state", _EV + "SELECT account_id, event_key, MIN(id) AS id FROM ev GROUP BY account_id, event_key")
def st1_by_state(spark, sf):
    return _streamed(spark, _batches(spark, fx.events_in(spark, sf), "id"), state.first_by_state).select("account_id", "event_key", "id")


_ENDED = _EV + """, w AS (SELECT event_key || ':' || COALESCE(CAST(account_id AS VARCHAR), '?') AS unique_key, id AS seq, CASE WHEN event_type = 'click' THEN 'parse_pdf' ELSE 'gmail_history_sync' END AS type, id % 4 = 0 AS done FROM ev),
    e AS (SELECT *, COUNT(*) FILTER (done) OVER (PARTITION BY unique_key ORDER BY seq) AS ended FROM w)
    SELECT unique_key, MIN(seq) AS seq, type FROM e WHERE NOT done GROUP BY unique_key, type, CASE WHEN type = 'parse_pdf' THEN 0 ELSE ended END"""


@query("st2_admit_work_by_state", _ENDED)
def st2_by_state(spark, sf):
    w = _work(spark, sf).select("unique_key", "type", "seq", F.lit(None).cast("timestamp").alias("at"), (c("seq") % 4 == 0).alias("done"))
    return _streamed(spark, _batches(spark, w, "seq"), state.admit_by_state).select("unique_key", "seq", "type")


@query("st2_known_keys", _EV + """, w AS (SELECT event_key || ':' || COALESCE(CAST(account_id AS VARCHAR), '?') AS unique_key, id AS seq, event_type FROM ev WHERE event_type = 'click')
    SELECT unique_key, MIN(seq) AS seq FROM w GROUP BY unique_key""")
def st2_known(spark, sf):
    log, out = keyed.KeyLog(spark, f"{work_dir(spark)}/known-{uuid.uuid4().hex}", 64, 2), None
    for n, rows in enumerate(_batches(spark, _work(spark, sf).filter("type = 'parse_pdf'"), "seq", 4)):
        fresh = materialize(events.admit_work(rows, log.known(rows, n), rows.limit(0)), "admitted")
        log.add(fresh, n)
        out = fresh if out is None else out.unionByName(fresh)
    return out.select("unique_key", "seq")


def _kept_by_key(spark, sf, upsert):
    """A stored table of the even half of the orders, into which the odd half comes in three batches."""
    base, upd = _halves(spark, sf)
    base = base.select("id", "v", "s")
    table = keyed.KeyedTable(spark, f"{work_dir(spark)}/keyed-{uuid.uuid4().hex}", base.schema, ["id"], 32)
    for n, rows in enumerate([base, *_batches(spark, upd.select("id", "v", "s"), "v")]):
        upsert(table, rows, n)
        upsert(table, rows, n)  # replayed: nothing changes
    return table.read()


@query("s06_upsert_latest_stored", _HALVES + "SELECT id, COALESCE(u.v, t.v) AS v, CASE WHEN u.id IS NOT NULL THEN u.s ELSE t.s END AS s FROM t FULL JOIN u USING (id)")
def s06_stored(spark, sf):
    return _kept_by_key(spark, sf, lambda table, rows, n: table.upsert_latest(rows, "v", n))


@query("s07_upsert_coalesce_stored", """WITH o AS (SELECT o_custkey AS id, o_orderkey AS v, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS s FROM orders),
    b AS (SELECT *, MIN(v) FILTER (v % 2 = 1) OVER () AS lo, MAX(v) FILTER (v % 2 = 1) OVER () AS hi FROM o),
    n AS (SELECT id, v, s, CASE WHEN v % 2 = 0 THEN -1 ELSE (v - lo) // ((hi - lo) // 3 + 1) END AS batch FROM b),
    r AS (SELECT id, batch, MAX(v) AS v, arg_max(COALESCE(s, ''), v) AS s FROM n GROUP BY id, batch)
    SELECT id, arg_max(v, batch) AS v, arg_max(s, batch) FILTER (s <> '') AS s FROM r GROUP BY id""")
def s07_stored(spark, sf):
    newest = lambda rows: rows.groupBy("id").agg(F.max_by(F.struct("v", "s"), "v").alias("r")).select("id", "r.*")
    return _kept_by_key(spark, sf, lambda table, rows, n: table.upsert_coalesce(newest(rows), ["s"], n))


@query("j12_route_by_email", stored.cte("accounts") + "SELECT event_id, x.id AS account_id FROM (SELECT event_id, 'USER' || user_id || '@EXAMPLE.com' AS email FROM events) e LEFT JOIN accounts x ON lower(x.email) = lower(e.email)")
def j12(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", F.concat(F.lit("USER"), c("user_id").cast("string"), F.lit("@EXAMPLE.com")).alias("email"))
    return events.route_by_email(ev, _st(spark, sf, "accounts")[0]).select("event_id", "account_id")


def _subs(spark, sf):
    k = c("event_id")
    return fx.table(spark, sf, "events").select(
        k.alias("id"), F.when(k % 11 != 0, F.concat(F.lit("sub-"), c("user_id").cast("string"))).alias("subscription_id"),
        F.concat(F.lit("secret-"), F.when(k % 5 != 0, c("user_id") % 7).otherwise(F.lit(99)).cast("string")).alias("client_state"),
        F.lit(None).cast("string").alias("message_id"), F.when(k % 13 != 0, F.concat(F.lit("me/messages/"), (k % 400).cast("string"))).alias("resource"),
        F.lit("created").alias("change_type"), F.lit(None).cast("string").alias("expires"),
    )


_SUB = stored.cte("accounts") + """, e AS (SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN 'sub-' || user_id END AS sub, 'secret-' || CASE WHEN event_id % 5 <> 0 THEN user_id % 7 ELSE 99 END AS st,
      CASE WHEN event_id % 13 <> 0 THEN event_id % 400 END AS mid FROM events),
    r AS (SELECT e.id, x.id AS account_id, mid, CASE WHEN sub IS NULL THEN 'no_subscription' WHEN x.id IS NULL OR x.status <> 'active' THEN 'unknown_or_inactive_account'
      WHEN st <> x.client_state THEN 'client_state_mismatch' WHEN mid IS NULL THEN 'no_message' END AS rejected FROM e LEFT JOIN accounts x ON x.subscription_id = e.sub)"""


@query("j13_route_by_subscription", _SUB + "SELECT id, rejected FROM r")
def j13(spark, sf):
    return events.route_by_subscription(_subs(spark, sf), _st(spark, sf, "accounts")[0]).select("id", "rejected")


@query("a25_notification_counts", _SUB + """SELECT outcome, COUNT(*) AS n FROM (SELECT CASE WHEN rejected IS NOT NULL THEN 'rejected' WHEN id = MIN(id) OVER (PARTITION BY account_id, mid, rejected) THEN 'accepted' ELSE 'duplicate' END AS outcome FROM r) GROUP BY 1""")
def a25(spark, sf):
    return events.notification_counts(events.notification_outcomes(events.route_by_subscription(_subs(spark, sf), _st(spark, sf, "accounts")[0])))


@query("st5_decode_notifications", "SELECT event_id, 'u' || user_id || '@x.example' AS email, CAST(event_id AS VARCHAR) AS history_id, 'm-' || event_id AS event_key FROM events")
def st5(spark, sf):
    j = F.concat(F.lit('{"emailAddress":"u'), c("user_id").cast("string"), F.lit('@x.example","historyId":'), c("event_id").cast("string"), F.lit("}"))
    b64 = F.regexp_replace(F.translate(F.base64(F.encode(j, "utf-8")), "+/", "-_"), "[=\r\n]", "")
    ev = fx.table(spark, sf, "events").select("event_id", b64.alias("data"), F.concat(F.lit("m-"), c("event_id").cast("string")).alias("message_id"))
    return events.decode_notifications(ev).select("event_id", "email", "history_id", "event_key")


def _history(spark, sf):
    return fx.table(spark, sf, "events").groupBy("user_id", (c("event_id") % 4).alias("page_no")).agg(
        F.collect_set(F.when(c("event_type") == "click", F.concat(F.lit("m"), (c("event_id") % 50).cast("string")))).alias("added"),
        F.collect_set(F.when(c("event_type") == "view", F.concat(F.lit("m"), (c("event_id") % 50).cast("string")))).alias("touched"),
        F.max("event_id").cast("string").alias("history_id"),
    ).withColumn("account_id", c("user_id")).withColumn("not_found", (c("user_id") % 13 == 0) & (c("page_no") == 0))


def _cursors(spark, sf):
    return fx.table(spark, sf, "events").select(c("user_id").alias("account_id")).distinct().withColumn("cursor", F.when(c("account_id") % 10 != 0, "c1"))


@query("st3_history_to_messages", """SELECT DISTINCT user_id AS account_id, 'gmail-message:' || user_id || ':m' || (event_id % 50) AS unique_key FROM events
    WHERE event_type IN ('click', 'view') AND user_id % 10 <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE user_id % 13 = 0 AND event_id % 4 = 0)""")
def st3(spark, sf):
    return events.history_to_messages(_history(spark, sf), _cursors(spark, sf))[0].select("account_id", "unique_key")


@query("st4_delta_to_messages", "SELECT DISTINCT user_id AS account_id, 'outlook-message:' || user_id || ':m' || (event_id % 50) AS unique_key FROM events WHERE event_id % 4 <> 0 AND event_type <> 'error'")
def st4(spark, sf):
    m = F.struct(F.concat(F.lit("m"), (c("event_id") % 50).cast("string")).alias("id"), (c("event_id") % 4 == 0).alias("removed"), (c("event_type") != "error").alias("has_attachments"))
    pages = fx.table(spark, sf, "events").select(c("user_id").alias("account_id"), c("event_id").alias("page_no"), F.array(m).alias("messages"), F.lit("link").alias("delta_link"))
    return events.delta_to_messages(pages)[0].select("account_id", "unique_key")


@query("st7_replay_keys", "SELECT event_id, 'gmail-message:' || user_id || ':' || event_id || ':reprocess:r1' AS unique_key FROM events")
def st7(spark, sf):
    w = fx.table(spark, sf, "events").select("event_id", F.lit("gmail").alias("provider"), c("user_id").alias("account_id"), c("event_id").cast("string").alias("message_id"))
    return events.replay_keys(w, "r1").select("event_id", "unique_key")


@query("st11_rescan", "SELECT DISTINCT user_id AS account_id, 'gmail-message:' || user_id || ':m' || (event_id % 50) || ':reprocess:r1' AS unique_key FROM events")
def st11(spark, sf):
    pages = fx.table(spark, sf, "events").select(c("user_id").alias("account_id"), F.array(F.concat(F.lit("m"), (c("event_id") % 50).cast("string"))).alias("message_ids"))
    return mail.rescan_to_messages(pages, "r1").select("account_id", "unique_key")


@query("st12_resolve_owner", stored.cte("accounts") + "SELECT event_id, COALESCE(CASE WHEN event_id % 3 = 0 THEN 'me' END, x.owner_user_id) AS owner_user_id FROM events LEFT JOIN accounts x ON x.id = user_id")
def st12(spark, sf):
    w = fx.table(spark, sf, "events").select("event_id", c("user_id").alias("account_id"), F.when(c("event_id") % 3 == 0, "me").otherwise("").alias("owner_user_id"))
    return events.resolve_owner(w, _st(spark, sf, "accounts")[0]).select("event_id", "owner_user_id")


# --- mail ------------------------------------------------------------------------------


def _patterned(spark, sf):
    m = fx.messages(spark, sf).withColumn("owner_user_id", (c("account_id") % 3).cast("string"))
    settings = m.select("owner_user_id").distinct().filter("owner_user_id != '2'").select(
        "owner_user_id", F.when(c("owner_user_id") == "0", F.array(F.lit(r"^INVOICE_\d+"), F.lit("zzz"))).otherwise(F.array().cast("array<string>")).alias("patterns"))
    return m, settings


_MSG = """WITH m AS (SELECT conv_id, turn, conv_id || '-' || turn AS message_id, CAST(conv_id % 3 AS VARCHAR) AS owner, left(text, 60) AS subject, text AS body,
    CASE WHEN turn % 2 = 0 THEN 'invoice_' || conv_id || '_' || turn || '.pdf' ELSE 'Note ' || conv_id || '.txt' END AS filename FROM conversations)"""


@query("p09_filter_candidates", _MSG + "SELECT message_id, CASE WHEN owner = '0' THEN 'invoice_hint' ELSE 'pdf_attachment' END AS candidate_reason FROM m WHERE owner <> '0' OR regexp_matches(filename, '(?i)^INVOICE_\\d+') OR contains(lower(body), 'zzz') OR contains(lower(subject), 'zzz')")
def p09(spark, sf):
    m, settings = _patterned(spark, sf)
    return mail.filter_candidates(m, settings).select("message_id", "candidate_reason")


@query("p08_is_invoice_candidate", _MSG + "SELECT message_id, regexp_matches(filename, '(?i)^INVOICE_\\d+_2') OR regexp_matches(body, '(?i)the') AS a FROM m")
def p08(spark, sf):
    return fx.messages(spark, sf).select("message_id", mail.is_invoice_candidate([c("filename"), c("body")], F.array(F.lit(r"^INVOICE_\d+_2"), F.lit("the"))).alias("a"))


def _mime(spark, sf):
    m = fx.messages(spark, sf)
    b64 = lambda t: F.regexp_replace(F.translate(F.base64(F.encode(t, "utf-8")), "+/", "-_"), "[=\r\n]", "")
    part = lambda mime, name, data: F.struct(F.lit(mime).alias("mimeType"), name.alias("filename"), F.struct(data.alias("data")).alias("body"))
    inner = F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(part("text/plain", F.lit(""), b64(c("body")))).alias("parts"))
    outer = F.to_json(F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(F.to_json(inner), F.to_json(part("application/octet-stream", c("filename"), b64(F.lit("%PDF-1.7"))))).alias("parts")))
    # to_json of an array of JSON texts quotes them; unquote to get real nesting
    return m.select("message_id", F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), F.to_json(inner), F.lit(","), F.to_json(part("application/octet-stream", c("filename"), b64(F.lit("%PDF-1.7")))), F.lit("]}")).alias("payload"))


@query("p14_mime_pdf_parts", _MSG + "SELECT message_id, '0001' AS path, filename FROM m WHERE filename LIKE '%.pdf'")
def p14(spark, sf):
    return mail.pdf_parts(mail.mime_parts(_mime(spark, sf))).select("message_id", "path", "filename")


@query("p14_body_text", _MSG + "SELECT message_id, body FROM m WHERE body <> ''")
def p14b(spark, sf):
    return mail.body_text(mail.mime_parts(_mime(spark, sf))).select("message_id", "body")


@query("p12_valid_pdf", _MSG + "SELECT message_id, turn % 2 = 0 AND conv_id % 5 <> 0 AS a FROM m")
def p12(spark, sf):
    k = F.substring_index("message_id", "-", -1).cast("long")
    data = F.base64(F.encode(F.concat(F.when(k % 2 == 0, "%PDF-1.4 ").otherwise(F.lit("<html> ")), c("subject")), "utf-8"))
    return fx.messages(spark, sf).select("message_id", mail.valid_pdf(F.regexp_replace(data, "\r\n", ""), F.when(c("account_id") % 5 == 0, "99999999").otherwise("10"), False).isNotNull().alias("a"))


@query("p13_provider_attachments", _MSG + "SELECT message_id FROM m WHERE turn % 3 <> 1 AND conv_id % 4 <> 1")
def p13(spark, sf):
    k = F.substring_index("message_id", "-", -1).cast("long")
    att = fx.messages(spark, sf).select("message_id", F.when(k % 3 == 0, "#microsoft.graph.fileAttachment").when(k % 3 == 1, "#microsoft.graph.itemAttachment").alias("odata_type"), (c("account_id") % 4 == 1).alias("is_inline"))
    return mail.provider_attachments(att).select("message_id")


# --- evaluation and truth --------------------------------------------------------------


def _compared(spark, sf):
    """Parsed invoices against truth, every 6th vendor and every 10th balance off."""
    inv = fx.invoices(spark, sf)
    t = inv.select(
        F.when(c("k") % 30 == 0, F.lit("shared")).otherwise(c("doc_id")).alias("source"), "doc_id", "invoice_number", "issue_date", "due_date", "currency",
        F.when(c("k") % 6 == 0, F.lit("Other")).otherwise(c("vendor")).alias("seller"), "buyer",
        F.when(c("k") % 10 == 0, c("balance_due") + 1).otherwise(c("balance_due")).alias("balance_due"))
    return evaluate.compare_fields(evaluate.truth_join(fx.parsed(inv), t))


_CMP = """cmp AS (SELECT doc_id, k, unnest(['invoice_number','issue_date','due_date','currency','buyer']) AS field, true AS matched FROM inv WHERE k % 30 <> 0
    UNION ALL SELECT doc_id, k, 'seller', k % 6 <> 0 FROM inv WHERE k % 30 <> 0 UNION ALL SELECT doc_id, k, 'balance_due', k % 10 <> 0 FROM inv WHERE k % 30 <> 0)"""


@query("r12_compare_fields", with_inv("SELECT doc_id, field, matched FROM cmp", _CMP))
def r12(spark, sf):
    return _compared(spark, sf)


@query("a10_field_accuracy", with_inv("SELECT field, COUNT(*) FILTER (WHERE matched) AS matched, COUNT(*) AS total, round(COUNT(*) FILTER (WHERE matched) / COUNT(*), 4) AS accuracy FROM cmp GROUP BY field", _CMP))
def a10(spark, sf):
    return evaluate.field_accuracy(_compared(spark, sf))


@query("a11_tag_accuracy", with_inv("SELECT 'tag' || (k % 4) AS tag, COUNT(*) FILTER (WHERE matched) AS matched, COUNT(*) AS total, round(COUNT(*) FILTER (WHERE matched) / COUNT(*), 4) AS accuracy FROM cmp GROUP BY 1", _CMP))
def a11(spark, sf):
    tags = fx.invoices(spark, sf).select("doc_id", F.concat(F.lit("tag"), (c("k") % 4).cast("string")).alias("tag"))
    return evaluate.tag_accuracy(_compared(spark, sf), tags)


def _two_item_sets(spark, sf):
    it = fx.line_items(spark, sf).select(c("k").cast("string").alias("doc_id"), "k", "description", "quantity", "unit_price", "amount")
    wrong = it.withColumn("amount", F.when(c("k") % 5 == 0, c("amount") + 1).otherwise(c("amount"))).filter("k % 7 != 0")
    return wrong, it


@query("a12_line_item_prf", with_inv("""
    , a AS (SELECT k, description AS d, CASE WHEN k % 5 = 0 THEN amount + 1 ELSE amount END AS m, COUNT(*) AS n FROM items WHERE k % 7 <> 0 GROUP BY 1, 2, 3),
    t AS (SELECT k, description AS d, amount AS m, COUNT(*) AS n FROM items GROUP BY 1, 2, 3),
    s AS (SELECT SUM(LEAST(a.n, t.n)) AS tp FROM a JOIN t USING (k, d, m)), p AS (SELECT SUM(n) AS p FROM a), e AS (SELECT SUM(n) AS e FROM t)
    SELECT CAST(tp AS BIGINT) AS matched_rows, CAST(p AS BIGINT) AS predicted_rows, CAST(e AS BIGINT) AS expected_rows, round(tp / p, 4) AS precision, round(tp / e, 4) AS recall, round(2 * (tp / p) * (tp / e) / (tp / p + tp / e), 4) AS f1 FROM s, p, e""".replace("\n    , a AS", "\n    a AS"), ITEMS).replace("items AS (", "items AS (", 1).replace(")\n\n    a AS", "),\n    a AS"))
def a12(spark, sf):
    return evaluate.line_item_prf(*_two_item_sets(spark, sf))


@query("r13_compare_line_items", with_inv("SELECT doc_id, k % 5 <> 0 OR n_lines = 0 AS matched FROM inv"))
def r13(spark, sf):
    from pyspark.sql.window import Window

    it = fx.line_items(spark, sf)
    w = Window.partitionBy("k").orderBy("line", "partkey", "suppkey", "quantity", "amount", "ship_date")
    t = it.withColumn("index", F.row_number().over(w)).select(c("k").cast("string").alias("doc_id"), "k", "index", "description", "quantity", "unit_price", "amount")
    a = t.withColumn("amount", F.when((c("k") % 5 == 0) & (c("index") == 1), c("amount") + 1).otherwise(c("amount")))
    docs = fx.table(spark, sf, "orders").select(c("o_orderkey").cast("string").alias("doc_id"))
    return evaluate.compare_line_items(a, t, docs).select("doc_id", "matched")


@query("a13_status_counts", with_inv("SELECT CASE WHEN k % 23 = 0 THEN 'no_text_layer' WHEN k % 19 = 0 THEN 'needs_review' ELSE 'parsed' END AS status, COUNT(*) AS n FROM inv GROUP BY 1"))
def a13(spark, sf):
    return evaluate.value_counts(fx.parsed(fx.invoices(spark, sf)), "status")


@query("a14_latency_summary", """WITH n AS (SELECT COUNT(*) AS n FROM events), r AS (SELECT value, ROW_NUMBER() OVER (ORDER BY value) AS i FROM events)
    SELECT round(median(value), 2) AS p50, round(MAX(value) FILTER (WHERE i = LEAST(n, GREATEST(1, CAST(round_even(0.95 * n + 0.5, 0) AS BIGINT)))), 2) AS p95, round(MAX(value), 2) AS max FROM r, n""")
def a14(spark, sf):
    return evaluate.latency_summary(fx.table(spark, sf, "events"), "value")


@query("a16_parse_summary", with_inv("SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE k % 23 <> 0 AND k % 19 <> 0) AS parsed, COUNT(*) FILTER (WHERE k % 23 = 0 OR k % 19 = 0) AS failed, 0 AS warnings, CAST(SUM(n_lines) AS BIGINT) AS line_items FROM inv"))
def a16(spark, sf):
    return evaluate.parse_summary(fx.parsed(fx.invoices(spark, sf)))


def _documents(spark, sf):
    """Invoices as manifest documents, for the truth tables."""
    inv = fx.invoices(spark, sf)
    amt = lambda n: F.struct(c(n).cast("string").alias("value"), c(n).cast("string").alias("visible_value"), F.concat(F.lit("USD "), c(n).cast("string")).alias("display"))
    party = lambda n: F.struct(c(n).alias("name"), F.lit("1 Road").alias("line1"), F.lit("City").alias("city"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("tax_id"))
    day = lambda n: F.struct(c(n).cast("string").alias("value"), F.date_format(n, "dd/MM/yyyy").alias("display"))
    d = F.struct(
        c("doc_id").alias("document_id"), F.array(F.concat(F.lit("s-"), "doc_id"), F.lit("x")).alias("sample_ids"), "invoice_number", "purchase_order", c("order_status").alias("status"),
        party("vendor").alias("seller"), party("buyer").alias("buyer"), day("issue_date").alias("issue_date"), day("due_date").alias("due_date"), F.lit("Net 30").alias("terms"), "currency",
        F.map_from_arrays(F.array(F.lit("seller"), F.lit("buyer")), F.array(F.lit("From"), F.when(c("k") % 4 == 0, "To").otherwise("Bill To"))).alias("labels"),
        F.map_from_arrays(F.array(*[F.lit(x) for x in ("subtotal", "discount", "tax", "balance_due")]), F.array(*[amt(x) for x in ("subtotal", "discount", "tax", "balance_due")])).alias("amounts"),
        F.array(F.struct(F.lit("table").alias("variant"), F.lit(True).alias("numeric"))).alias("cols"),
        F.array_sort(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("challenge_tags"),
    )
    return inv.select("k", "n_lines", F.lit("corpus.manifest.json").alias("origin"), F.lit(1).alias("schema_version"), F.lit("standard").alias("suite"), F.lit(None).cast("string").alias("fixture_slug"),
                      F.lit("x.pdf").alias("pdf_filename"), F.lit(1).alias("pdf_page_count"), d.alias("d"))


@query("r01_truth_rows", with_inv("SELECT doc_id AS document_id, invoice_number, COALESCE(vendor, '') AS vendor_name, buyer AS customer_name, issue_date, strftime(due_date, '%d/%m/%Y') AS due_date_display, subtotal, balance_due FROM inv"))
def r01(spark, sf):
    return truth.truth_rows(_documents(spark, sf)).select("document_id", "invoice_number", "vendor_name", "customer_name", "issue_date", "due_date_display", "subtotal", "balance_due")


@query("r02_truth_labels", with_inv("SELECT doc_id AS document_id, 'seller' AS label_key, 'From' AS label_text FROM inv UNION ALL SELECT doc_id, 'buyer', CASE WHEN k % 4 = 0 THEN 'To' ELSE 'Bill To' END FROM inv"))
def r02(spark, sf):
    return truth.truth_labels(_documents(spark, sf))


@query("r03_truth_amounts", with_inv(" UNION ALL ".join(f"SELECT doc_id AS document_id, '{x}' AS amount_key, {x} AS amount_value, 'USD ' || {x} AS display_value FROM inv" for x in ("subtotal", "discount", "tax", "balance_due"))))
def r03(spark, sf):
    return truth.truth_amounts(_documents(spark, sf)).drop("visible_value")


@query("r07_truth_sample_ids", with_inv("SELECT doc_id AS document_id, 1 AS sample_index, 's-' || doc_id AS sample_id FROM inv UNION ALL SELECT doc_id, 2, 'x' FROM inv"))
def r07(spark, sf):
    return truth.truth_sample_ids(_documents(spark, sf))


@query("r08_truth_tags", with_inv("SELECT doc_id AS document_id, unnest(['a', 'b']) AS challenge_tag FROM inv"))
def r08(spark, sf):
    return truth.truth_tags(_documents(spark, sf))


def _star_documents(spark, sf):
    """The documents with their line items, a table (but for every seventh) and one page for five lines."""
    money = lambda n: F.struct(c(n).cast("string").alias("value"), F.lit(None).cast("string").alias("visible_value"), F.concat(F.lit("$"), c(n).cast("string")).alias("display"))
    one = F.struct(c("line").cast("int").alias("line"), c("partkey").cast("string").alias("sku"), F.lit(None).cast("string").alias("hsn"), c("description").alias("name"), F.lit("").alias("description"),
                   c("quantity").cast("string").alias("quantity"), F.concat(c("quantity").cast("string"), F.lit(" pcs")).alias("quantity_display"), money("unit_price").alias("unit_price"), money("amount").alias("amount"),
                   F.struct(c("ship_date").cast("string").alias("value"), F.lit(None).cast("string").alias("display")).alias("service_date"))
    items = fx.line_items(spark, sf).groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("items"))
    docs = _documents(spark, sf).join(items, "k", "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    k = c("k")
    column = lambda name, numeric: F.struct(F.lit(name).alias("key"), F.upper(F.lit(name)).alias("label"), numeric.cast("boolean").alias("numeric"))
    table = F.when(k % 7 != 0, F.struct(
        F.when(k % 3 == 0, "grid").otherwise("plain").alias("variant"), F.array(column("name", F.lit(None)), F.when(k % 2 == 0, column("amount", F.lit(True)))).alias("columns"),
        F.when(k % 2 == 0, True).alias("show_description"), F.lit("below").alias("total_placement"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("continued_across_pages")))
    page = lambda i: F.struct(
        F.when(k % 2 == 0, i + 11).otherwise(F.lit(0)).cast("int").alias("pdf_page_number"), (i + 1).cast("int").alias("document_page_number"), F.lit(None).cast("int").alias("document_page_count"), F.lit("x").alias("sample_id"),
        F.transform(F.slice("items", i * 5 + 1, 5), lambda x: F.when(x["line"] != 2, x["line"])).alias("line_item_numbers"), F.when(i > 0, True).alias("table_continues_from_previous_page"), F.lit(None).cast("boolean").alias("table_continues_after_page"),
        (F.size("items") <= i * 5 + 5).alias("renders_totals"), F.lit(None).cast("string").alias("total_placement"), F.lit(None).cast("boolean").alias("notes_near_table_bounds"),
        F.array(F.struct(F.lit("table").alias("kind"), F.array((k % 50) / 4, F.lit(2.5), F.lit(100.0), F.lit(40.0)).alias("bbox_mm")), F.struct(F.lit(None).cast("string").alias("kind"), F.array(F.lit(1.0)).alias("bbox_mm"))).alias("components"))
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("items") / 5).cast("int") - 1, F.lit(0))), page)
    return docs.withColumn("d", c("d").withField("line_items", c("items")).withField("table", table).withField("pages", pages)).drop("items")


_LINES = """, l AS (SELECT l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS line, COALESCE(p_name, 'item') AS name, CAST(l_quantity AS DECIMAL(12,4)) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, CAST(l_shipdate AS DATE) AS day,
        ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR), l_extendedprice) AS i FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
    g AS (SELECT k, doc_id AS document_id, n_lines, UNNEST(range(GREATEST(CAST(ceil(n_lines / 5) AS BIGINT), 1))) AS page FROM inv)"""


def _star_sql(select: str) -> str:
    return with_inv("SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + _LINES + " " + select


def _star_query(name: str, build, sql: str, *columns: str) -> None:
    query(name, _star_sql(sql))(lambda spark, sf: build(_star_documents(spark, sf)).select(*columns))


_PAGE_NUMBER = "CASE WHEN g.k % 2 = 0 THEN g.page + 11 ELSE g.page + 1 END"
_R04 = "SELECT document_id, i AS line_item_index, line AS line_number, name AS item_name, quantity, amount AS amount_value, '$' || amount AS amount_display, day AS service_date FROM l"
_R05 = "SELECT doc_id AS document_id, CASE WHEN k % 3 = 0 THEN 'grid' ELSE 'plain' END AS variant, k % 2 = 0 AS show_description, k % 5 = 1 AS continued_across_pages FROM inv WHERE k % 7 <> 0"
_R06 = "SELECT doc_id AS document_id, 1 AS column_index, 'name' AS column_key, 'NAME' AS column_label, false AS is_numeric FROM inv WHERE k % 7 <> 0 UNION ALL SELECT doc_id, 2, 'amount', 'AMOUNT', true FROM inv WHERE k % 7 <> 0 AND k % 2 = 0"
_R09 = f"SELECT document_id, {_PAGE_NUMBER} AS pdf_page_number, page + 1 AS document_page_number, page > 0 AS table_continues_from_previous_page, n_lines <= page * 5 + 5 AS renders_totals FROM g"
_R10 = f"SELECT l.document_id, {_PAGE_NUMBER} AS pdf_page_number, (l.i - 1) % 5 + 1 AS line_item_index, l.line AS line_number FROM l JOIN g ON g.k = l.k AND g.page = (l.i - 1) // 5 WHERE l.line <> 2"
_R11 = f"SELECT document_id, {_PAGE_NUMBER} AS pdf_page_number, 1 AS component_index, 'table' AS component_kind, CAST((k % 50) / 4 AS DECIMAL(10,2)) AS bbox_x_mm, CAST(2.5 AS DECIMAL(10,2)) AS bbox_y_mm FROM g UNION ALL SELECT document_id, {_PAGE_NUMBER}, 2, '', 1, NULL FROM g"
_star_query("r04_truth_line_items", truth.truth_line_items, _R04, "document_id", "line_item_index", "line_number", "item_name", "quantity", "amount_value", "amount_display", "service_date")
_star_query("r05_truth_tables", truth.truth_tables, _R05, "document_id", "variant", "show_description", "continued_across_pages")
_star_query("r06_truth_table_columns", truth.truth_table_columns, _R06, "document_id", "column_index", "column_key", "column_label", "is_numeric")
_star_query("r09_truth_pages", truth.truth_pages, _R09, "document_id", "pdf_page_number", "document_page_number", "table_continues_from_previous_page", "renders_totals")
_star_query("r10_truth_page_items", truth.truth_page_items, _R10, "document_id", "pdf_page_number", "line_item_index", "line_number")
_star_query("r11_truth_components", truth.truth_components, _R11, "document_id", "pdf_page_number", "component_index", "component_kind", "bbox_x_mm", "bbox_y_mm")

_STAR_TABLES = {"labels": "SELECT doc_id AS document_id FROM inv, range(2)", "line_items": _R04, "tables": _R05, "table_columns": _R06, "pages": _R09, "page_items": _R10, "components": _R11,
                "truth": "SELECT doc_id AS document_id FROM inv", "amounts": "SELECT doc_id AS document_id FROM inv, range(4)", "sample_ids": "SELECT doc_id AS document_id FROM inv, range(2)", "tags": "SELECT doc_id AS document_id FROM inv, range(2)"}


@query("r14_truth_star", _star_sql("SELECT tab, batch, document_id, COUNT(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS tab, document_id FROM ({sql})" for name, sql in _STAR_TABLES.items()) + ") x JOIN (SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM inv WHERE k % 2 = 0 OR k % 3 = 0) b ON b.doc_id = x.document_id GROUP BY ALL"))
def r14(spark, sf):
    """Two batches, the second one written again with fewer documents."""
    docs, path = _kept(spark, sf, "star-documents", lambda: _star_documents(spark, sf)), f"{work_dir(spark)}/star-{uuid.uuid4().hex}"
    for batch, some in (("odd", "k % 2 = 1"), ("even", "k % 2 = 0"), ("odd", "k % 2 = 1 AND k % 3 = 0")):
        truth.write_truth_star(docs.filter(some).drop("k"), path, batch, stored=True)
    out = None
    for name in truth.STAR:
        rows = truth.read_truth_star(spark, path, name).groupBy("document_id", "batch_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), c("batch_id").alias("batch"), "document_id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a02_truth_summary", with_inv("SELECT doc_id AS document_id, balance_due, n_lines AS line_item_count FROM inv"))
def a02(spark, sf):
    items = fx.line_items(spark, sf).select(c("k").cast("string").alias("document_id"))
    return truth.truth_summary(truth.truth_rows(_documents(spark, sf)), items).select("document_id", "balance_due", "line_item_count")


@query("j21_first_sample", with_inv("SELECT doc_id AS document_id, 's-' || doc_id AS sample_id FROM inv WHERE k % 3 = 0"))
def j21(spark, sf):
    docs = _documents(spark, sf)
    samples = docs.filter("k % 3 = 0").select(F.get("d.sample_ids", 0).alias("sample_id"), c("k").alias("seed"))
    return truth.first_sample(docs.select(c("d.document_id").alias("document_id"), c("d.sample_ids").alias("sample_ids")), samples).select("document_id", "sample_id")


@query("j20_infer_metadata", "SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 'ledger-clean' WHEN o_orderkey % 3 = 1 THEN 'ledger' ELSE 'unknown' END AS template_slug, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey END AS sample_seed FROM orders")
def j20(spark, sf):
    k = c("o_orderkey")
    sid = F.concat(F.when(k % 3 == 0, "ledger-clean-a4-").when(k % 3 == 1, "ledger-a4-").otherwise("other-a4-"), k.cast("string"), F.lit("-2-p1"))
    docs = fx.table(spark, sf, "orders").select(k.cast("string").alias("document_id"), F.array(sid).alias("sample_ids"))
    # the slug lists are reference data of a few rows, taken from the tables' own size
    slugs = lambda *names: fx.table(spark, sf, "region").select(F.get(F.array(*[F.lit(n) for n in names]), c("r_regionkey").cast("int")).alias("slug")).filter("slug is not null")
    return truth.infer_metadata(docs, slugs("ledger", "ledger-clean", "audit"), slugs("a4", "letter")).select("document_id", "template_slug", "sample_seed")


def _page_rows(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.groupBy(c("l_orderkey").cast("string").alias("document_id"), c("l_linenumber").alias("pdf_page_number")).agg(F.max("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"))


@query("a17_assemble_documents", """WITH p AS (SELECT l_orderkey, l_linenumber, MAX(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
    SELECT CAST(l_orderkey AS VARCHAR) AS document_id, COUNT(*) AS page_count, arg_min(s, l_linenumber) AS first_sample, COUNT(*) > 1 AS continued_across_pages FROM p GROUP BY 1""")
def a17(spark, sf):
    pages = _page_rows(spark, sf).select("document_id", "pdf_page_number", c("pdf_page_number").alias("page_index"), c("s").alias("sample_id"), F.lit(None).cast("string").alias("ap_context"), F.lit(False).alias("continues"))
    return truth.assemble_documents(pages).select("document_id", "page_count", "first_sample", "continued_across_pages")


@query("a18_combine_line_items", """SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS line, arg_max(l_partkey, l_suppkey * 1000000 + l_partkey) AS partkey FROM lineitem GROUP BY 1, 2""")
def a18(spark, sf):
    items = fx.table(spark, sf, "lineitem").select(c("l_orderkey").cast("string").alias("document_id"), c("l_linenumber").alias("line"), c("l_suppkey").alias("page"), c("l_partkey").alias("pos"), c("l_partkey").alias("partkey"))
    return truth.combine_line_items(items).select("document_id", "line", "partkey")


@query("a19_total_placement", """WITH p AS (SELECT l_orderkey, l_linenumber, CASE MIN(l_returnflag) WHEN 'A' THEN 'table_row' WHEN 'N' THEN 'side_panel' ELSE 'none' END AS f FROM lineitem GROUP BY 1, 2)
    SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CASE WHEN COUNT(DISTINCT NULLIF(f, 'none')) = 0 THEN 'none' WHEN COUNT(DISTINCT NULLIF(f, 'none')) > 1 THEN 'mixed' ELSE MIN(NULLIF(f, 'none')) END AS total_placement FROM p GROUP BY 1""")
def a19(spark, sf):
    return truth.total_placement(_page_rows(spark, sf).withColumn("placement", truth.page_placement(c("flag") == "A", c("flag") == "N")))


@query("a20_challenge_tags", with_inv("""SELECT doc_id AS document_id, array_to_string(list_filter([CASE WHEN k % 4 = 0 THEN 'ambiguous_entity_labels' END, CASE WHEN k % 3 = 0 THEN 'localized_decimal_separator' END,
    CASE WHEN n_lines > 1 THEN 'multi_page_invoice' END, CASE WHEN n_lines > 4 THEN 'totals_in_side_panel' END], lambda x: x IS NOT NULL), ',') AS tags FROM inv"""))
def a20(spark, sf):
    d = _documents(spark, sf).select(
        c("d.document_id").alias("document_id"), c("n_lines").alias("page_count"), F.lit(False).alias("continues"), F.lit(False).alias("notes_near"), F.when(c("n_lines") > 4, "side_panel").otherwise("none").alias("placement"),
        c("d.labels").alias("labels"), c("d.currency").alias("currency"), F.when(c("k") % 3 == 0, "comma-decimal").alias("money_style"), F.array().cast("array<string>").alias("own_tags"), F.array().cast("array<string>").alias("edge_tags"))
    return truth.challenge_tags(d).select("document_id", joined(c("challenge_tags")).alias("tags"))


@query("a21_notes_near_table", "SELECT l_orderkey, l_linenumber, l_quantity <= 8 AS near FROM lineitem")
def a21(spark, sf):
    comp = lambda kind, y, h: F.struct(F.lit(kind).alias("kind"), F.array(F.lit(0.0), y, F.lit(9.0), h).alias("bbox_mm"))
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", truth.notes_near_table(F.array(comp("items-table", F.lit(10.0), F.lit(20.0)), comp("terms", F.lit(30.0) + c("l_quantity"), F.lit(5.0)))).alias("near"))


@query("a22_distinct_edge_cases", "SELECT CAST(user_id AS VARCHAR) AS document_id, MIN(event_id) AS page FROM events GROUP BY user_id, props")
def a22(spark, sf):
    cases = fx.table(spark, sf, "events").select(c("user_id").cast("string").alias("document_id"), c("event_id").alias("page"), F.lit(0).alias("pos"), F.when(c("event_id") % 2 == 0, c("props")).otherwise(F.regexp_replace("props", " ", "")).alias("case"))
    return truth.distinct_edge_cases(cases).select("document_id", "page")


# --- second source ---------------------------------------------------------------------


def _second(spark, sf):
    """A second reading of every field: every third more confident, some values different."""
    inv = fx.invoices(spark, sf)
    base = inv.select("doc_id", "k", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c(f).cast("string").alias("value")) for f in ("invoice_number", "due_date", "buyer")])).alias("r")).select("doc_id", "k", "r.*")
    null = lambda t: F.lit(None).cast(t)

    def shaped(value, conf):
        return base.select("doc_id", "field", value.alias("raw"), value.alias("value"), null("double").alias("amount"), null("string").alias("currency"), F.lit(1).alias("page"),
                           F.array(*[F.lit(x) for x in (1.0, 2.0, 9.0, 4.0)]).alias("bbox"), c("field").alias("label"), conf.alias("confidence"), F.lit("m").alias("method"),
                           F.expr(merge.NONE).alias("ambiguity_reasons"), null("array<struct<raw:string>>").alias("alternatives"))

    first = shaped(c("value"), F.when(c("k") % 2 == 0, 0.7).otherwise(0.9))
    second = shaped(F.when(c("k") % 5 == 0, F.upper("value")).otherwise(F.concat("value", F.lit("x"))), F.when(c("k") % 3 == 0, 0.95).otherwise(0.8))
    return first, second


@query("u5_merge_sources", with_inv("""SELECT doc_id, field, CASE WHEN k % 5 = 0 THEN false WHEN k % 2 = 0 THEN true ELSE k % 3 = 0 END AS applied FROM inv, (SELECT unnest(['invoice_number', 'due_date', 'buyer']) AS field)"""))
def u5(spark, sf):
    return merge.merge_sources(*_second(spark, sf)).select("doc_id", "field", "applied")


@query("u6_tag_source", with_inv("SELECT doc_id, 'full_document_ocr:m' AS method FROM inv, range(3)"))
def u6(spark, sf):
    return merge.tag_source(_second(spark, sf)[1]).select("doc_id", "method")


@query("w04_rank_regions", with_inv("SELECT doc_id, unnest(['invoice_number', 'due_date', 'buyer']) AS field, unnest([1, 2, 3]) AS position FROM inv WHERE k % 2 = 0"))
def w04(spark, sf):
    first, _ = _second(spark, sf)
    pages = first.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit("").alias("text"))
    return merge.rank_regions(first, pages).select("doc_id", "field", "position")


@query("a28_region_summary", with_inv("SELECT doc_id, CASE WHEN k % 4 = 3 THEN 'skipped' WHEN k % 4 = 2 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN k % 4 = 3 THEN 0 ELSE 2 END::BIGINT AS candidate_count FROM inv"))
def a28(spark, sf):
    inv = fx.invoices(spark, sf)
    r = inv.filter("k % 4 != 3").select("doc_id", F.explode(F.array(F.lit("applied"), F.when(c("k") % 4 == 2, "failed").otherwise("rejected"))).alias("outcome"))
    return merge.region_summary(inv, r).select("doc_id", "status", "candidate_count")


def _contract(spark, sf):
    """External extractions as JSON; every 5th breaks the contract in one of two ways."""
    inv = fx.invoices(spark, sf)
    val = lambda v: F.concat(F.lit('{"value":"'), v, F.lit('","confidence":0.95}'))
    num = lambda v: F.concat(F.lit('{"value":'), v.cast("string"), F.lit(',"confidence":0.95}'))
    null = F.lit('{"value":null,"confidence":0}')
    parts = {
        "seller": val(F.coalesce("vendor", F.lit("x"))), "buyer": val(c("buyer")), "invoice_number": val(c("invoice_number")),
        "issue_date": val(F.when(c("k") % 10 == 5, "03/04/2020").otherwise(c("issue_date").cast("string"))), "due_date": val(c("due_date").cast("string")),
        "purchase_order": null, "terms": null, "currency": val(F.lit("USD")), "subtotal": num(c("subtotal")), "discount": num(c("discount")), "tax": num(c("tax")),
        "shipping": null, "paid": null, "balance_due": F.when(c("k") % 10 == 0, val(c("balance_due").cast("string"))).otherwise(num(c("balance_due"))), "payment_instructions": null,
        "line_items": F.lit("[]"),
    }
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()])
    kind = F.when(c("k") % 7 == 0, "not_invoice").otherwise("invoice")
    return inv, inv.select("doc_id", F.concat(F.lit('{"schema_version":1,"document_type":"'), kind, F.lit('","warnings":[],"fields":{'), body, F.lit("}}")).alias("payload"))


@query("x12_validate_extractions", with_inv("SELECT doc_id, CASE WHEN k % 10 = 0 THEN 'fields.balance_due is invalid' WHEN k % 10 = 5 THEN 'fields.issue_date.value must be a valid YYYY-MM-DD date' END AS reason FROM inv"))
def x12(spark, sf):
    return merge.validate_extractions(_contract(spark, sf)[1]).select("doc_id", "reason")


@query("x13_promote_extractions", with_inv("SELECT doc_id, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'needs_review' ELSE 'parsed' END AS status, k % 5 <> 0 AND k % 7 <> 0 AS promoted FROM inv"))
def x13(spark, sf):
    inv, ext = _contract(spark, sf)
    parsed = inv.select("doc_id", F.lit("needs_review").alias("status"), F.array().cast("array<string>").alias("warnings"))
    return merge.promote_extractions(parsed, ext, "external").select("doc_id", "status", "promoted")


# --- operators that other queries only use -----------------------------------------------


@query("p20_weak_geometry", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.85 THEN 'weak_geometry' ELSE '' END AS reasons FROM lineitem")
def p20(spark, sf):
    weak = candidates.weak_geometry(F.col("l_discount").cast("double") * 10)
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", joined(weak).alias("reasons"))


@query("u4_key_diff", """SELECT l_orderkey, list_aggregate(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(h, x))), 'string_agg', ',') AS missing,
    list_aggregate(list_sort(list_filter(h, lambda x: NOT list_contains(['A', 'N', 'R'], x))), 'string_agg', ',') AS extra
    FROM (SELECT l_orderkey, list(DISTINCT CASE WHEN l_linenumber = 5 THEN 'line5' ELSE l_returnflag END) AS h FROM lineitem GROUP BY 1)""")
def u4(spark, sf):
    flag = F.when(F.col("l_linenumber") == 5, "line5").otherwise(F.col("l_returnflag"))
    have = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.map_from_entries(F.transform(F.collect_set(flag), lambda k: F.struct(k, F.lit(1)))).alias("h"))
    diff = have.select("l_orderkey", merge.key_diff(F.col("h"), ["A", "N", "R"]).alias("d"))
    return diff.select("l_orderkey", F.nullif(joined(F.col("d.missing")), F.lit("")).alias("missing"), F.nullif(joined(F.col("d.extra")), F.lit("")).alias("extra"))


@query("x15_record_source_failure", """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old,second unavailable: ' || 'timeout' WHEN o_orderkey % 3 = 1 THEN 'second unavailable: timeout' ELSE 'second unavailable: timeout,old' END AS warnings,
    true AS attempted, false AS promoted FROM orders""")
def x15(spark, sf):
    k, said = F.col("o_orderkey"), "second unavailable: timeout"
    before = F.when(k % 3 == 0, F.array(F.lit("old"))).when(k % 3 == 1, F.array(F.lit(said))).otherwise(F.array(F.lit(said), F.lit("old")))
    docs = fx.table(spark, sf, "orders").select(k.alias("doc_id"), before.alias("warnings"))
    out = merge.record_source_failure(docs, "timeout", "second", "failed")
    return out.select("doc_id", joined(F.col("warnings")).alias("warnings"), "second_source.attempted", "second_source.promoted")


@query("a29_merge_summary", """WITH b AS (SELECT l_orderkey AS doc_id, list_sort(list(DISTINCT 's' || l_suppkey % 7)) AS m, list_sort(list(DISTINCT 's' || l_suppkey % 7) FILTER (WHERE l_quantity > 25)) AS n,
    list_sort(list(DISTINCT l_returnflag) FILTER (WHERE l_linenumber > 2)) AS f FROM lineitem GROUP BY 1)
    SELECT doc_id, CASE WHEN len(m) > 0 THEN 'missing_required_fields' ELSE 'unresolved_fields' END AS trigger, array_to_string(list_filter(m, lambda x: NOT list_contains(COALESCE(n, []), x)), ',') AS recovered,
      COALESCE(array_to_string(f, ','), '') AS applied FROM b""")
def a29(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc_id").withColumn("mode", F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")))
    before = li.groupBy("doc_id").agg(F.sort_array(F.collect_set("mode")).alias("missing"))
    after = li.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("mode")))).alias("missing"))
    merged = li.select("doc_id", F.col("l_returnflag").alias("field"), (F.col("l_linenumber") > 2).alias("applied"))
    return merge.merge_summary(before, after, merged).select("doc_id", "trigger", joined(F.col("recovered")).alias("recovered"), joined(F.col("applied_fields")).alias("applied"))


@query("p21_line_items_need_review", """SELECT l_orderkey AS doc_id, bool_or(l_discount * 10 < 0.85 OR l_tax * 12 < 0.85 AND l_tax > 0.02 OR l_linenumber = 6) AS needs_review FROM lineitem GROUP BY 1""")
def p21(spark, sf):
    c = F.col
    role = lambda conf, reasons: F.struct(conf.cast("double").alias("confidence"), reasons.cast("array<string>").alias("ambiguity_reasons"))
    none = F.array().cast("array<string>")
    items = fx.table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("doc_id"), role(c("l_discount") * 10, none).alias("description"), F.when(c("l_tax") > 0.02, role(c("l_tax") * 12, none)).alias("quantity"),
        role(F.lit(0.99), F.when(c("l_linenumber") == 6, F.array(F.lit("multiple_amounts"))).otherwise(none)).alias("unit_price"), role(F.lit(1.0), none).alias("amount"))
    return extract.line_items_need_review(items)


@query("j17_calibrate_confidence", """WITH w AS (SELECT l_orderkey AS doc_id, round(1 - l_discount * 4, 2) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(1 - l_discount * 4, 2)) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n
    FROM lineitem WHERE l_linenumber <= 5) SELECT doc_id, round(c, 3)::DOUBLE AS word_confidence FROM w WHERE r = round_even((n - 1) * 0.2, 0) + 1""")
def j17(spark, sf):
    c = F.col
    li = fx.table(spark, sf, "lineitem")
    words = li.select(c("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.round(1 - c("l_discount") * 4, 2).cast("double").alias("confidence"), (c("l_linenumber") * 10.0).alias("x0"), (c("l_linenumber") * 10.0 + 4).alias("x1"), F.lit(0.0).alias("top"), F.lit(8.0).alias("bottom"))
    fields = li.select(c("l_orderkey").cast("string").alias("doc_id")).distinct().select("doc_id", F.lit("total").alias("field"), F.lit(1).alias("page"), F.array(F.lit(0.0), F.lit(0.0), F.lit(55.0), F.lit(9.0)).alias("bbox"), F.lit(0.99).alias("confidence"), F.lit("second").alias("method"), F.array().cast("array<string>").alias("ambiguity_reasons"))
    out = grid.calibrate_confidence(fields, words)
    return out.filter("word_confidence is not null").select(c("doc_id").cast("long").alias("doc_id"), "word_confidence")
