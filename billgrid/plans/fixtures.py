"""Invoice-shaped views over the TPC-H-like tables (see FIXTURES.md part B).

Every view grows with its source tables and is built by joins and aggregates on order keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billgrid.functions import lexicon as lx
from billgrid.functions import text as tx
from billgrid.operators import normalize
from billgrid.schemas import CONTEXT, REFERENCE
from billgrid.session import materialize

DEC = "decimal(12,2)"

SCENARIOS = (
    "none", "split_po_partial_billing", "amount_variance_within_tolerance", "amount_variance_above_tolerance",
    "duplicate_invoice_number_normalized", "missing_po_implied_match", "vendor_bank_detail_changed",
    "credit_memo_negative_balance",
)
EXPECTED = (
    "approve", "approve_partial_consumption", "approve_with_tolerance", "needs_review", "flag_possible_duplicate",
    "needs_review", "block_or_escalate", "apply_credit_or_route_review",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice lines in a fixed order; part name is the description."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate",
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("description"))
    return li.join(part, "l_partkey", "left").select(
        "k", F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"),
        F.coalesce("description", F.lit("item")).alias("description"),
        F.col("l_quantity").cast(DEC).alias("quantity"), F.col("l_extendedprice").cast(DEC).alias("amount"),
        (F.col("l_extendedprice").cast(DEC) / F.col("l_quantity").cast(DEC)).cast(DEC).alias("unit_price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount_rate"), F.col("l_tax").cast("decimal(4,2)").alias("tax_rate"),
        F.to_date("l_shipdate").alias("ship_date"),
    )


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """One invoice per order."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_suppkey", F.col("l_extendedprice").cast(DEC).alias("p"),
        F.col("l_discount").cast("decimal(4,2)").alias("d"), F.col("l_tax").cast("decimal(4,2)").alias("t"),
    )
    sums = li.groupBy("k").agg(
        F.min("l_suppkey").alias("suppkey"),
        F.sum("p").cast(DEC).alias("subtotal"),
        F.sum((F.col("p") * F.col("d")).cast(DEC)).cast(DEC).alias("discount"),
        F.sum((F.col("p") * F.col("t")).cast(DEC)).cast(DEC).alias("tax"),
        F.count("*").alias("n_lines"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("issue_date"),
        F.col("o_orderstatus").alias("order_status"),
    ).repartition("k")  # spread by key: what follows is heavy per row, and a small file is one split
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("buyer"), F.col("c_nationkey").alias("nationkey")
    )
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("owner"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("vendor"))
    zero = F.lit(0).cast(DEC)
    return (
        orders.join(sums, "k", "left").join(customer, "custkey", "left").join(nation, "nationkey", "left")
        .join(supplier, "suppkey", "left")
        .select(
            "k", F.col("k").cast("string").alias("doc_id"), "owner",
            F.format_string("INV-%06d", "k").alias("invoice_number"),
            F.when(F.col("k") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("PO-"), F.col("k").cast("string"))).alias("purchase_order"),
            "vendor", "buyer", "suppkey", "issue_date", F.date_add("issue_date", 30).alias("due_date"),
            *[F.coalesce(c, zero).cast(DEC).alias(c) for c in ("subtotal", "discount", "tax")],
            (F.coalesce("subtotal", zero) - F.coalesce("discount", zero) + F.coalesce("tax", zero)).cast(DEC).alias("balance_due"),
            F.lit("USD").alias("currency"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "order_status",
            F.when(F.col("suppkey").isNotNull(), F.format_string("**** %04d", F.col("suppkey") % 10000)).alias("bank_account"),
        )
    )


def scenario_index() -> Column:
    return (F.col("k") % 8).cast("int")


def ap_records(inv: DataFrame) -> DataFrame:
    """Procurement records of the same orders, disturbed by ``k % 8``.

    Every 13th record has neither number nor purchase order, every 26th no date either.
    """
    # each normalized once: the record names them in several places
    inv = inv.withColumns({
        "_vendor": tx.normalize_vendor_name(F.col("vendor")), "_buyer": tx.normalize_vendor_name(F.col("buyer")),
        "_number": tx.normalize_invoice_number(F.col("invoice_number")), "_po": tx.normalize_purchase_order(F.col("purchase_order")),
    })
    s = scenario_index()
    name = F.get(F.array(*[F.lit(x) for x in SCENARIOS]), s)
    bal = F.col("balance_due")
    bare = F.col("k") % 13 == 0
    authorized = (
        F.when(s == 1, bal * 2).when(s == 2, bal / F.lit("1.01").cast("decimal(4,2)"))
        .when(s == 3, bal / F.lit("1.05").cast("decimal(4,2)")).otherwise(bal)
    ).cast(DEC)
    consumed = F.when(s == 1, (bal / 4).cast(DEC)).otherwise(F.lit(0).cast(DEC))
    has_po = (s != 5) & (F.col("purchase_order") != "") & ~bare
    po = F.when(has_po, F.col("purchase_order"))
    implied = F.concat(F.lit("PO-IMPLIED-"), F.col("k").cast("string"))
    context_po = F.coalesce(po, F.when(s == 5, implied))
    norm_vendor = F.col("_vendor")
    number = F.when(~bare, F.col("invoice_number"))
    norm_number, norm_po = F.when(number.isNotNull(), F.col("_number")), F.when(po.isNotNull(), F.col("_po"))

    def reference(num: Column) -> Column:
        return F.struct(
            num.alias("invoice_number"), tx.normalize_invoice_number(num).alias("normalized_invoice_number"),
            F.col("vendor").alias("vendor_name"), norm_vendor.alias("normalized_vendor"), po.alias("purchase_order"),
            F.coalesce(norm_po, F.lit("")).alias("normalized_purchase_order"), F.lit(None).cast("string").alias("issue_date"),
            consumed.alias("total"), consumed.alias("applied_to_po"), F.lit("paid").alias("status"),
            F.lit(None).cast("string").alias("database"), F.lit(None).cast("string").alias("document_id"),
        )

    none = F.expr(f"cast(array() as array<{REFERENCE}>)")
    context = F.struct(
        name.alias("scenario"),
        F.struct(
            F.col("vendor").alias("name"), norm_vendor.alias("normalized_name"), F.expr("cast(array() as array<string>)").alias("aliases"),
            F.lit(None).cast("string").alias("vendor_id"), F.lit(None).cast("string").alias("tax_id"),
        ).alias("vendor"),
        F.struct(F.col("buyer").alias("name"), F.col("_buyer").alias("normalized_name")).alias("buyer"),
        F.struct(
            number.alias("invoice_number"), norm_number.alias("normalized_invoice_number"),
            F.col("issue_date").cast("string").alias("issue_date"), F.col("due_date").cast("string").alias("due_date"),
        ).alias("invoice"),
        F.col("currency").alias("currency"),
        F.struct(
            F.coalesce(context_po, F.lit("")).alias("po_number"), tx.normalize_purchase_order(context_po).alias("normalized"),
            authorized.alias("authorized_total"), consumed.alias("previously_consumed"),
            (authorized - consumed).cast(DEC).alias("remaining_before_invoice"),
        ).alias("purchase_order"),
        bal.alias("invoice_total"),
        F.when((s == 6) & F.col("suppkey").isNotNull(), F.format_string("**** %04d", (F.col("suppkey") + 1) % 10000)).otherwise(F.col("bank_account")).alias("approved_bank_account"),
        F.struct(F.lit(None).cast("string").alias("bank_account"), F.lit(None).cast("string").alias("remit_to")).alias("invoice_payment"),
        F.when(s == 1, F.array(reference(F.concat(F.lit("P-"), F.col("invoice_number"))))).otherwise(none).alias("previous_invoices"),
        F.when(s == 4, F.array(reference(F.col("invoice_number")))).otherwise(none).alias("duplicate_candidates"),
        F.when(s == 5, F.struct(
            implied.alias("po_number"), tx.normalize_purchase_order(implied).alias("normalized"), F.col("vendor").alias("vendor_name"),
            norm_vendor.alias("normalized_vendor"), bal.alias("authorized_total"), bal.alias("remaining_balance"),
        )).alias("candidate_open_po"),
        F.struct(F.lit("2.00").cast(DEC).alias("percent"), (authorized * 2 / 100).cast(DEC).alias("amount")).alias("tolerance_policy"),
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in ("subtotal", "discount", "tax", "balance_due")]),
            F.array(*[F.col(k) for k in ("subtotal", "discount", "tax", "balance_due")]),
        ).alias("amounts"),
        F.when(s.isin(2, 3), (bal - authorized).cast(DEC)).alias("variance_amount"),
        F.get(F.array(*[F.lit(x) for x in EXPECTED]), s).alias("expected_decision"),
    ).cast(CONTEXT)
    return inv.select(
        F.col("k").alias("id"), F.col("owner").alias("owner_user_id"),
        F.concat(F.lit("manifest:orders:"), F.col("doc_id")).alias("source_key"),
        F.col("vendor").alias("vendor_name"), norm_vendor.alias("normalized_vendor"),
        po.alias("purchase_order"), norm_po.alias("normalized_purchase_order"),
        number.alias("invoice_number"), norm_number.alias("normalized_invoice_number"),
        bal.alias("invoice_total"), F.when(F.col("k") % 26 != 0, F.col("issue_date")).alias("issue_date"),
        name.alias("scenario"), context.alias("context"), F.col("issue_date").cast("timestamp").alias("updated_at"),
    )


def parsed(inv: DataFrame) -> DataFrame:
    """The same invoices in the shape a finished parse has, with some weak documents.

    Every 17th has an uncertain issue date, every 19th parser findings, every 23rd no text.
    """
    empty = "cast(array() as array<string>)"

    def field(value: Column, conf: Column, amount: Column | None = None) -> Column:
        return F.when(
            value.isNotNull() & (value != ""),
            F.struct(
                value.alias("raw"), value.alias("value"),
                (F.lit(None).cast("double") if amount is None else amount.cast("double")).alias("amount"),
                (F.lit(None).cast("string") if amount is None else F.lit("USD")).alias("currency"),
                F.lit(1).alias("page"), F.array(*[F.lit(x) for x in (10.0, 20.0, 80.0, 28.0)]).alias("bbox"),
                F.lit("label").alias("label"), conf.alias("confidence"), F.lit("fixture").alias("method"),
                F.expr(empty).alias("ambiguity_reasons"),
            ),
        )

    sure = F.lit(0.95)
    day = F.when(F.col("k") % 17 == 0, F.lit(0.55)).otherwise(sure)
    money = lambda c: field(F.concat(F.lit("USD "), F.col(c).cast("string")), sure, F.col(c))
    status = F.when(F.col("k") % 23 == 0, "no_text_layer").when(F.col("k") % 19 == 0, "needs_review").otherwise("parsed")
    text = lambda c, conf=sure: field(F.col(c).cast("string"), conf)
    return inv.select(
        "k", "doc_id", "owner", status.alias("status"), F.lit(lx.PARSER_VERSION).alias("parser_version"),
        text("invoice_number").alias("invoice_number"), text("issue_date", day).alias("issue_date"), text("due_date").alias("due_date"),
        text("purchase_order").alias("purchase_order"), field(F.lit("Net 30"), sure).alias("terms"), text("currency").alias("currency"),
        text("vendor").alias("seller"), text("buyer").alias("buyer"),
        *[money(c).alias(c) for c in ("subtotal", "discount", "tax", "balance_due")],
        *[F.when(F.lit(False), money("tax")).alias(c) for c in ("shipping", "paid")],
        field(F.col("bank_account"), sure).alias("payment_instructions"),
        F.col("n_lines").alias("item_count"), F.col("n_lines").alias("item_amounts"), F.col("subtotal").cast("double").alias("item_total"),
        (F.col("n_lines") * 0.005).alias("item_half_steps"), F.lit(False).alias("item_negative"),
        F.when(F.col("n_lines") > 0, F.array(F.lit("USD"))).otherwise(F.expr(empty)).alias("item_currencies"),
        F.expr(empty).alias("warnings"),
    )


def normalized(inv: DataFrame) -> DataFrame:
    return normalize.normalize_invoices(parsed(inv))


# --- word grids ------------------------------------------------------------------------

ROWS_PER_PAGE = 20
CHAR = 5.0


def rendered_words(inv: DataFrame, items: DataFrame, spread: int | None = None) -> DataFrame:
    """Every invoice printed as words on pages, so that extraction has a known answer.

    With ``spread`` (a number of partitions) lines are spread by page before they become words, which
    then need not be moved to be brought together.
    """
    seg = lambda x, text: F.struct(F.lit(float(x)).alias("x"), text.alias("t"))
    ln = lambda page, top, *segs: F.struct(page.alias("page"), top.cast("double").alias("top"), F.array(*segs).alias("segs"))
    usd = lambda c: F.concat(F.lit("USD "), F.col(c).cast("string"))
    one = F.lit(1)
    last_page = F.greatest(F.ceil(F.col("n_lines") / ROWS_PER_PAGE), F.lit(1)).cast("int")
    rows_there = F.col("n_lines") - (last_page - 1) * ROWS_PER_PAGE
    below = F.when(last_page == 1, 246.0).otherwise(20.0) + rows_there * 14 + 20
    put = lambda i, x, t: ln(last_page, below + 14 * i, seg(x, t))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    head = F.array_compact(F.array(
        ln(one, F.lit(20), seg(300, text("Invoice No ", "invoice_number"))),
        ln(one, F.lit(34), seg(300, text("Invoice Date ", "issue_date"))),
        ln(one, F.lit(48), seg(300, text("Due Date ", "due_date"))),
        F.when(F.col("purchase_order") != "", ln(one, F.lit(62), seg(300, text("Purchase Order ", "purchase_order")))),
        ln(one, F.lit(76), seg(300, F.lit("Terms Net 30"))),
        F.when(F.col("vendor").isNotNull(), ln(one, F.lit(100), seg(20, F.lit("From")))),
        F.when(F.col("vendor").isNotNull(), ln(one, F.lit(112), seg(20, F.col("vendor")))),
        ln(one, F.lit(140), seg(20, F.lit("Bill To"))),
        ln(one, F.lit(152), seg(20, F.col("buyer"))),
        F.when(F.col("n_lines") > 0, ln(one, F.lit(230), seg(20, F.lit("Item")), seg(260, F.lit("Qty")), seg(320, F.lit("Rate")), seg(420, F.lit("Amount")))),
        put(0, 300, F.concat(F.lit("Subtotal "), usd("subtotal"))),
        put(1, 300, F.concat(F.lit("Discount "), usd("discount"))),
        put(2, 300, F.concat(F.lit("Tax "), usd("tax"))),
        put(3, 300, F.concat(F.lit("Balance Due "), usd("balance_due"))),
        F.when(F.col("bank_account").isNotNull(), put(6, 20, F.lit("Payment Instructions"))),
        F.when(F.col("bank_account").isNotNull(), put(7, 20, F.concat(F.lit("Acct "), F.col("bank_account")))),
    ))
    header = inv.select("doc_id", F.explode(head).alias("l"))
    order = Window.partitionBy("k").orderBy("line", "partkey", "suppkey", "quantity", "amount", "discount_rate", "tax_rate", "ship_date")
    body = (
        items.withColumn("i", F.row_number().over(order) - 1)
        .withColumn("page", (F.floor(F.col("i") / ROWS_PER_PAGE) + 1).cast("int"))
        .withColumn("top", F.when(F.col("page") == 1, 246.0).otherwise(20.0) + (F.col("i") % ROWS_PER_PAGE) * 14)
        .select(
            F.col("k").cast("string").alias("doc_id"),
            ln(
                F.col("page"), F.col("top"), seg(20, F.col("description")), seg(260, F.col("quantity").cast("int").cast("string")),
                seg(320, usd("unit_price")), seg(420, usd("amount")),
            ).alias("l"),
        )
    )
    printed = header.unionByName(body).select("doc_id", F.col("l.page").alias("page"), F.col("l.top").alias("top"), F.col("l.segs").alias("segs"))
    return _split_segments(printed.repartition(spread, "doc_id", "page") if spread else printed)


def _split_segments(lines: DataFrame) -> DataFrame:
    """Segments to words: each character is five points wide."""
    words = lines.select("doc_id", "page", "top", F.explode("segs").alias("s")).select(
        "doc_id", "page", "top", "s.x", F.posexplode(F.split("s.t", " ")).alias("i", "text"), F.split("s.t", " ").alias("all")
    )
    offset = F.length(F.array_join(F.slice("all", F.lit(1), F.col("i")), " ")) + F.when(F.col("i") > 0, 1).otherwise(0)
    x0 = F.col("x") + offset * CHAR
    return words.select(
        "doc_id", "page", "text", x0.alias("x0"), "top", (x0 + F.length("text") * CHAR).alias("x1"),
        (F.col("top") + 8.0).alias("bottom"), F.lit(None).cast("double").alias("confidence"),
    )


def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of ``documents.text`` on a monospaced grid, 60 lines to a page."""
    return words_on_grid(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


def words_on_grid(docs: DataFrame) -> DataFrame:
    """A word begins where its line has got to: a line's places follow from the line itself. Only the lines
    of documents that share an id run on into each other, word by word."""
    shared = materialize(docs.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id"), "shared-ids")
    some = lambda how: docs.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), how).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    chars = F.transform(F.split("line", ""), lambda ch, i: F.when(ch == " ", i + 1))
    own = F.col("line").alias("line"), F.concat(F.array(F.lit(0)), F.array_compact(chars)).alias("starts")
    alone = (
        some("left_anti").select("doc_id", "n", *own)
        .select("doc_id", "n", F.explode(F.arrays_zip(F.split("line", " ").alias("text"), F.col("starts").alias("off"))).alias("w"))
        .select("doc_id", "n", "w.text", F.col("w.off").cast("long").alias("off"))
    )
    toks = some("left_semi").select("doc_id", "n", F.posexplode(F.split("line", " ")).alias("i", "text"))
    before = Window.partitionBy("doc_id", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    merged = toks.select("doc_id", "n", "text", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("off"))
    toks = alone.unionByName(merged).filter(F.trim("text") != "")
    top = (F.col("n") % 60) * 12.0
    return toks.select(
        "doc_id", (F.floor(F.col("n") / 60) + 1).cast("int").alias("page"), "text", (F.col("off") * 6.0).alias("x0"),
        top.alias("top"), ((F.col("off") + F.length("text")) * 6.0).alias("x1"), (top + 8.0).alias("bottom"),
        F.lit(None).cast("double").alias("confidence"),
    )


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page rows that belong to :func:`doc_words`, one per 60 lines, blank pages included."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.groupBy("doc_id", (F.floor(F.col("n") / 60) + 1).cast("int").alias("page")).agg(
        F.sum(F.length("line")).alias("char_count")
    ).select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), "char_count")


def doc_page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`doc_pages` with the text of each page: its 60 lines at most, in order."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.groupBy("doc_id", (F.floor(F.col("n") / 60) + 1).cast("int").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l")
    ).select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.array_join("l.line", "\n").alias("text"))


def events_in(spark: SparkSession, sf: str) -> DataFrame:
    """Notifications: account from the user, key from type and hour; every 9th user unknown."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit("gmail").alias("provider"),
        F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("account_id"),
        F.concat(F.col("event_type"), F.lit(":"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")).alias("event_key"),
        F.col("ts").cast("timestamp").alias("received_at"), "event_type", "value", "props",
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as mail messages."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("account_id"), F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.col("role").alias("sender"), F.left("text", F.lit(60)).alias("subject"), F.col("text").alias("body"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("invoice_"), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit(".pdf")))
        .otherwise(F.concat(F.lit("Note "), F.col("conv_id"), F.lit(".txt"))).alias("filename"),
    )
