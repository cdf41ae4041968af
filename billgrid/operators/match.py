"""Finding the procurement record of an invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billgrid.functions import lexicon as lx
from billgrid.functions import text as tx
from billgrid.functions.dates import date_or_null
from billgrid.functions.money import money_decimal
from billgrid.functions.similarity import similarity_bound, spectrum, text_similarity
from billgrid.session import materialize, scratch
from billgrid.operators.candidates import top_per_key
from billgrid.schemas import CONTEXT, REFERENCE

#: label of each tier when the vendor is equal, similar enough, or neither
TIERS = {
    1: ("vendor_po", "fuzzy_vendor_po", "po"),
    2: ("vendor_invoice_number", "fuzzy_vendor_invoice_number", "invoice_number"),
    3: ("vendor_amount_date", "fuzzy_vendor_amount_date", "amount_date"),
}


def match_keys(inv: DataFrame) -> DataFrame:
    """Match values of normalized invoices (doc_id, owner, vendor, po, number, amount, day)."""
    return inv.select(
        "doc_id", "owner",
        F.coalesce("vendor.normalized_name", F.lit("")).alias("vendor"),
        F.coalesce("purchase_order.normalized", F.lit("")).alias("po"),
        F.coalesce("invoice_number.normalized", F.lit("")).alias("number"),
        F.col("amount_due.amount").alias("amount"),
        date_or_null(F.col("issue_date.value")).alias("day"),
    )


def _key(tier: int, sub: int, key: Column, question: Column | None = None) -> Column:
    """A lookup key; ``question`` names what is asked when one question spans two keys."""
    return F.when(
        key.isNotNull(),
        F.struct(
            F.lit(tier).alias("tier"), F.lit(sub).alias("sub"), key.alias("key"),
            (key if question is None else question).alias("q"),
        ),
    )


def _amount_key(kind: str, amount: Column, day: Column | None = None) -> Column:
    parts = [F.lit(kind), amount.try_cast("decimal(38,2)").cast("string")]
    return F.when(amount.try_cast("decimal(38,2)").isNotNull(), F.concat_ws("|", *parts, *([day.cast("string")] if day is not None else [])))


def contenders(questions: DataFrame, offers: DataFrame) -> DataFrame:
    """Questions (owner, tier, key, q, vendor) with those offers of their key that can be the most like.

    The offer of the highest bound is compared first; only offers whose bound reaches its similarity
    are left. So an offer that is missing here is less like than one that is not.
    """
    asked = questions.withColumn("_a", spectrum(F.col("vendor")))
    # only offers of asked keys are counted
    offers = offers.join(questions.select("owner", "tier", "key").distinct(), ["owner", "tier", "key"], "left_semi")
    bound = similarity_bound(F.col("vendor"), F.col("_a"), F.col("ap_vendor"), F.col("_b"))
    met = materialize(asked.join(offers.withColumn("_b", spectrum(F.col("ap_vendor"))), ["owner", "tier", "key"]).withColumn("bound", bound).drop("_a", "_b"), "vendor-bounds")
    question = ["owner", "tier", "q", "vendor"]
    first = met.groupBy(*question).agg(F.max(F.struct("bound", "ap_vendor")).alias("m")).select(*question, F.col("m.ap_vendor").alias("ap_vendor"))
    reached = first.join(_compared(first), ["vendor", "ap_vendor"]).select(*question, F.col("similarity").alias("reached"))
    return met.join(reached, question).filter("bound >= reached").drop("bound", "reached")


def _compared(pairs: DataFrame) -> DataFrame:
    """Similarity of each distinct pair of names."""
    return pairs.select("vendor", "ap_vendor").distinct().withColumn("similarity", text_similarity(F.col("vendor"), F.col("ap_vendor")))


def _contest(questions: DataFrame, offers: DataFrame) -> DataFrame:
    left = materialize(contenders(questions, offers), "vendor-contenders")
    return left.join(_compared(left), ["vendor", "ap_vendor"])


def match_ap_context(keys: DataFrame, ap: DataFrame) -> DataFrame:
    """The record of each invoice, by purchase order, else number, else amount and date.

    Per tier all records of a key compete on vendor similarity (W2), the newer one on ties; the
    first tier with any record wins. Blank keys match nothing.

    Tiers are asked one after another, each only by the invoices the ones before left open. Keys
    may be very uneven, so a key keeps the newest record of each vendor. No record beats one of
    the very vendor, so those are met by an equi-join. Only what is left is reduced to distinct
    (key, vendor) questions: one without a vendor takes the newest record, the others meet the
    key's other vendors, of which those that a bound rules out are never compared
    (:func:`contenders`).

    Output: doc_id, ap_id, similarity, match_strategy (only matched invoices).
    """
    blank = tx.null_if_empty
    amount, day = F.col("amount"), F.col("day")
    asked = {
        1: [_key(1, 0, blank(F.col("po")))],
        2: [_key(2, 0, blank(F.col("number")))],
        # a dated invoice prefers records of its day, then records without a date
        3: [
            _key(3, 0, F.when(day.isNotNull(), _amount_key("on", amount, day))),
            _key(3, 1, F.when(day.isNotNull(), _amount_key("undated", amount)), _amount_key("on", amount, day)),
            _key(3, 1, F.when(day.isNull(), _amount_key("any", amount))),
        ],
    }
    total, issued = F.col("invoice_total"), F.col("issue_date")
    offered = {
        1: [_key(1, 0, blank(F.col("normalized_purchase_order")))],
        2: [_key(2, 0, blank(F.col("normalized_invoice_number")))],
        3: [
            _key(3, 0, F.when(issued.isNotNull(), _amount_key("on", total, issued))),
            _key(3, 1, F.when(issued.isNull(), _amount_key("undated", total))),
            _key(3, 1, _amount_key("any", total)),
        ],
    }
    with scratch(keys.sparkSession):
        # the records are read by every tier; how they are made can be long
        ap = materialize(ap.select(
            "owner_user_id", "id", "updated_at", "normalized_vendor", "normalized_purchase_order", "normalized_invoice_number", "invoice_total", "issue_date",
        ), "match-records")
        state, won = keys.select("doc_id", "owner", "vendor", "po", "number", "amount", "day"), []
        for tier in TIERS:
            offers = ap.select(
                F.col("owner_user_id").alias("owner"), F.struct("updated_at", F.col("id").alias("ap_id")).alias("o"),
                F.coalesce("normalized_vendor", F.lit("")).alias("ap_vendor"), F.explode(F.array_compact(F.array(*offered[tier]))).alias("k"),
            ).select("owner", "ap_vendor", "k.tier", "k.key", "o")
            open_, hits = _ask(state, asked[tier], offers)
            won.append(materialize(hits.select(F.lit(tier).alias("tier"), "*"), f"match-won-{tier}"))
            # rows of one id are one invoice
            done = won[-1].select(F.col("doc_id").alias("_done"))
            state = open_.join(done, F.col("doc_id").eqNullSafe(F.col("_done")), "left_anti")
        found = won[0].unionByName(won[1]).unionByName(won[2])
        return materialize(found.select(
            "doc_id", "ap_id", F.round("similarity", 3).alias("similarity"),
            match_strategy(F.col("tier"), F.col("vendor"), F.col("ap_vendor"), F.round("similarity", 3)).alias("match_strategy"),
        ), "matches", outside=True)


def _ask(state: DataFrame, asked: list[Column], offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invoices to which no record of their very vendor answered, and per document the record that won."""
    newest = offers.groupBy("owner", "key", "ap_vendor").agg(F.max("o").alias("o"))
    asks = state.select("*", F.explode_outer(F.array_compact(F.array(*asked))).alias("k")).select(*state.columns, "k.*")
    same = newest.filter("ap_vendor <> ''").withColumnRenamed("ap_vendor", "vendor")
    asks = materialize(asks.join(same, ["owner", "key", "vendor"], "left"), "match-asks")
    question = ["owner", "tier", "q", "vendor"]
    exact = asks.filter("o is not null").select(
        "doc_id", *question, F.struct(F.lit(1.0).alias("similarity"), (-F.col("sub")).alias("s"), "o.updated_at", "o.ap_id").alias("b"), F.col("vendor").alias("ap_vendor"))
    if len(asked) > 1:
        # a question that spans keys is settled by any of them
        exact = exact.groupBy("doc_id", *question).agg(F.max("b").alias("b"), F.max("ap_vendor").alias("ap_vendor"))
    exact = exact.select("doc_id", "b.ap_id", "b.similarity", "vendor", "ap_vendor")

    rest = asks.filter("o is null and key is not null").drop("o")
    if len(asked) > 1:
        rest = rest.join(asks.filter("o is not null").select(*question).distinct(), question, "left_anti")
    # one contest per distinct question
    questions = materialize(rest.select(*question, "sub", "key").distinct(), "match-questions")
    near = materialize(offers.join(questions.select("owner", "key").distinct(), ["owner", "key"], "left_semi"), "match-offers")
    near = near.groupBy("owner", "tier", "key", "ap_vendor").agg(F.max("o").alias("o"))
    of_key = near.groupBy("owner", "tier", "key").agg(F.max(F.struct("o", "ap_vendor")).alias("n")).select("owner", "tier", "key", "n.o", "n.ap_vendor")
    named, unnamed = questions.filter("vendor <> ''"), questions.filter("vendor = ''")
    columns = [*question, "sub", "ap_vendor", "o.updated_at", "o.ap_id"]
    met = unnamed.join(of_key, ["owner", "tier", "key"]).select(*columns, F.lit(0.0).alias("similarity")).unionByName(
        _contest(named, near).select(*columns, "similarity")
    )
    best = met.groupBy(*question).agg(
        F.max_by(
            F.struct("ap_id", "similarity", "ap_vendor"),
            F.struct("similarity", (-F.col("sub")).alias("s"), "updated_at", "ap_id"),
        ).alias("b")
    ).select(*question, "b.*")
    hits = rest.select("doc_id", *question).join(best, question).select("doc_id", "ap_id", "similarity", "vendor", "ap_vendor")
    won = exact.unionByName(hits).groupBy("doc_id").agg(
        F.min(F.struct("ap_id", "similarity", "vendor", "ap_vendor")).alias("w")
    ).select("doc_id", "w.*")
    return asks.filter("o is null").select(*state.columns), won


def match_strategy(tier: Column, vendor: Column, ap_vendor: Column, similarity: Column) -> Column:
    """How the record was found."""
    out = F.lit(None).cast("string")
    for t, (exact, fuzzy, fallback) in TIERS.items():
        label = (
            F.when((vendor != "") & (vendor == ap_vendor), exact)
            .when(similarity >= lx.FUZZY_VENDOR, fuzzy)
            .otherwise(fallback)
        )
        out = F.when(tier == t, label).otherwise(out)
    return out


def best_ap_candidate(cands: DataFrame, keys, vendor: str, newest: int | None = None) -> DataFrame:
    """W2 alone: the candidate of each key with the most similar vendor, of the ``newest`` if given.

    Equal similarity keeps the newer record; a blank vendor takes the newest with 0.0.
    """
    recent = cands if newest is None else top_per_key(cands, keys, [F.desc("updated_at"), F.desc("ap_id")], newest)
    scored = recent.withColumn(
        "similarity",
        F.when(F.coalesce(F.col(vendor), F.lit("")) == "", F.lit(0.0)).otherwise(
            text_similarity(F.col(vendor), F.col("ap_vendor"))
        ),
    )
    best = Window.partitionBy(*keys).orderBy(F.desc("similarity"), F.desc("updated_at"), F.desc("ap_id"))
    return scored.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r").withColumn(
        "similarity", F.round("similarity", 3)
    )


# --- N4, J11: context of a matched record ----------------------------------------------

MISSING_REASON = lx.NO_CONTEXT_MATCHED


def hydrate_context(inv: DataFrame, matches: DataFrame, ap: DataFrame) -> DataFrame:
    """Attach the matched record's context; unmatched invoices get a reason instead.

    Adds context, context_available, context_reason, context_source, context_scenario.
    """
    records = ap.select(
        F.col("id").alias("ap_id"), F.col("source_key"), F.col("scenario").alias("_scenario"), F.col("invoice_number").alias("_number"),
        F.col("normalized_invoice_number").alias("_norm"), F.col("issue_date").alias("_issued"), "context",
    )
    usable = F.col("context").isNotNull()
    scenario = F.coalesce("context.scenario", "_scenario", F.lit("ap_context_record"))
    invoice = F.struct(
        F.coalesce("context.invoice.invoice_number", "_number").alias("invoice_number"),
        F.coalesce("context.invoice.normalized_invoice_number", "_norm").alias("normalized_invoice_number"),
        F.coalesce("context.invoice.issue_date", F.col("_issued").cast("string")).alias("issue_date"),
        F.col("context.invoice.due_date").alias("due_date"),
    )
    # wide rows that compress well look small enough to broadcast and aren't: both sides are sorted. What is attached
    # is whole before it moves to its invoices, so that parts nobody reads stay behind
    found = matches.join(records.hint("merge"), "ap_id", "left").select(
        *matches.columns, usable.alias("_usable"), F.when(usable, scenario).alias("context_scenario"),
        F.when(usable, F.struct(
            F.lit("ap_context_records").alias("type"), F.col("ap_id").alias("record_id"), "source_key", "match_strategy",
        )).alias("context_source"),
        F.when(usable, F.col("context").withField("scenario", scenario).withField("invoice", invoice)).alias("context"),
    )
    reason = F.when(F.col("ap_id").isNull(), F.lit(MISSING_REASON)).when(
        ~F.col("_usable"), F.lit("Matched accounts payable context record did not contain a usable context payload.")
    )
    return inv.join(found.hint("merge"), "doc_id", "left").withColumns({
        "context_available": F.coalesce("_usable", F.lit(False)), "context_reason": reason,
    }).drop("_usable")


def missing_context(inv: DataFrame, reason: str = lx.NO_CONTEXT_GIVEN) -> DataFrame:
    """Invoices decided without any procurement data."""
    return (
        inv.withColumn("context", F.lit(None).cast(CONTEXT))
        .withColumn("context_available", F.lit(False))
        .withColumn("context_scenario", F.lit(None).cast("string"))
        .withColumn("context_reason", F.lit(reason))
        .withColumn("context_source", F.lit(None).cast("struct<type:string,record_id:bigint,source_key:string,match_strategy:string>"))
    )


def summarize_context(hydrated: DataFrame) -> DataFrame:
    return hydrated.select(
        "doc_id",
        F.col("context_available").alias("available"),
        F.col("context_reason").alias("reason"),
        F.col("context_source.match_strategy").alias("match_strategy"),
        F.col("context_scenario").alias("scenario"),
        F.col("context.vendor.name").alias("vendor"),
        F.col("context.purchase_order.po_number").alias("purchase_order"),
        F.col("context.invoice_total").alias("invoice_total"),
        F.col("context.tolerance_policy.amount").alias("tolerance_amount"),
    )


def context_coverage(keys: DataFrame, ap: DataFrame) -> DataFrame:
    """Every invoice with whether and how a record was found."""
    found = match_ap_context(keys, ap).join(
        ap.select(F.col("id").alias("ap_id"), "scenario"), "ap_id", "left"
    )
    return keys.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.col("ap_id").isNotNull().alias("context_matched"), "match_strategy", "ap_id", "scenario"
    )


# --- J10: manifest documents -----------------------------------------------------------


def document_amount(doc: Column) -> Column:
    """Balance, else total, else subtotal of a manifest document."""
    a = doc["amounts"]
    return F.coalesce(*[money_decimal(F.try_element_at(a, F.lit(k))["value"]) for k in ("balance_due", "total", "subtotal")])


def select_document(invoices: DataFrame, docs: DataFrame) -> DataFrame:
    """The document of an invoice's own manifest that fits it best.

    ``invoices``: doc_id, source, number, po, vendor, amount, wanted (document id or NULL).
    ``docs``: source, position, document_id, number, po, vendor, amount. All keys normalized.
    Number counts 4, purchase order 3, vendor 2, amount within a cent 1. Without any agreement
    the first document stands; a wanted id decides alone.

    Invoices meet one document per kind of agreement by an equi-join, so a manifest with very
    many documents never forms all pairs. They first ask for agreement on all they have, which
    nothing exceeds; only those that find none ask for every lesser kind, in their manifests alone.
    """
    docs = materialize(docs.select("source", "position", "document_id", "number", "po", "vendor", "amount"), "manifest-documents")
    first = docs.groupBy("source").agg(F.min_by("document_id", "position").alias("first_id"))
    by_id = (
        invoices.filter("wanted is not null").select("doc_id", "source", "wanted")
        .join(docs.select("source", F.col("document_id").alias("wanted"), "position"), ["source", "wanted"])
        .groupBy("doc_id")
        .agg(F.min_by("wanted", "position").alias("document_id"))
        .withColumn("score", F.lit(None).cast("int"))
    )
    free = materialize(invoices.filter("wanted is null").select("doc_id", "source", "number", "po", "vendor", "amount"), "manifest-questions")
    asked = free.select("doc_id", "source", _agreements([-1, 0, 1]).alias("ks"))
    most = F.array_max(F.transform("ks", lambda k: k["score"]))
    whole = asked.select("doc_id", "source", F.explode(tx.let(most, lambda m: F.filter("ks", lambda k: k["score"] == m))).alias("k"))
    offered = docs.select("source", F.struct("position", "document_id").alias("at"), F.explode(_agreements([0])).alias("k"))
    # ten scores at most
    scores = whole.select(F.col("k.score").alias("score")).distinct()
    settled = _best_agreement(whole, offered.join(F.broadcast(scores), F.col("k.score") == scores["score"], "left_semi"))
    settled = materialize(settled.filter("score = most").drop("most"), "manifest-settled")
    done = settled.select(F.col("doc_id").alias("_done"))
    open_ = asked.join(done, F.col("doc_id").eqNullSafe(F.col("_done")), "left_anti")
    lesser = _best_agreement(
        open_.select("doc_id", "source", F.explode("ks").alias("k")),
        offered.join(open_.select("source").distinct(), "source", "left_semi"),
    ).filter("score is not null").drop("most")
    best = settled.unionByName(lesser)
    fallback = free.join(best, "doc_id", "left_anti").join(first, "source").select(
        "doc_id", F.col("first_id").alias("document_id"), F.lit(0).alias("score")
    )
    return by_id.unionByName(best).unionByName(fallback)


def _best_agreement(asks: DataFrame, offered: DataFrame) -> DataFrame:
    """The document of the highest score, then of the first place, that shares a key with each invoice (else NULL),
    and the highest score the invoice asks for."""
    offers = offered.groupBy("source", "k").agg(F.min("at").alias("at"))
    order = F.when(F.col("at").isNotNull(), F.struct("k.score", (-F.col("at.position")).alias("p")))
    return (
        asks.join(offers, ["source", "k"], "left")
        .groupBy("doc_id")
        .agg(F.max_by(F.struct("at.document_id", "k.score"), order).alias("b"), F.max("k.score").alias("most"))
        .select("doc_id", "b.document_id", "b.score", "most")
    )


def _agreements(cents: list[int]) -> Column:
    """Every way two records can agree: a score and the values that must be equal.

    All subsets of the four attributes that have values. A record pair agreeing on more is also
    found under the larger subset with its higher score, so the best score is exact although
    each subset only keeps its first document.
    """
    present = {n: F.coalesce(F.col(n), F.lit("")) != "" for n in ("number", "po", "vendor")}
    points = {"number": 4, "po": 3, "vendor": 2}
    money = F.floor(F.col("amount") * 100).cast("long")
    out = []
    for mask in range(1, 8):
        names = [n for i, n in enumerate(points) if mask & (1 << i)]
        have = F.lit(True)
        for n in names:
            have = have & present[n]
        values = F.concat_ws("\u0001", *[F.lit("+".join(names)), *[F.col(n) for n in names]])
        out.append(F.when(have, F.struct(F.lit(sum(points[n] for n in names)).alias("score"), values.alias("v"))))
        for c in cents:
            priced = F.concat_ws("\u0001", values, (money + c).cast("string"))
            out.append(F.when(have & money.isNotNull(), F.struct(F.lit(sum(points[n] for n in names) + 1).alias("score"), priced.alias("v"))))
    for c in cents:
        out.append(F.when(money.isNotNull(), F.struct(F.lit(1).alias("score"), F.concat(F.lit("amount="), (money + c).cast("string")).alias("v"))))
    return F.array_compact(F.array(*out))


# --- N3, U1: records from manifests ----------------------------------------------------


def invoice_reference(r: Column) -> Column:
    """A prior invoice named in raw procurement context, in canonical form."""
    blank = lambda c: tx.null_if_empty(c)
    return F.when(
        r.isNotNull(),
        F.struct(
            r["invoice_number"].alias("invoice_number"),
            F.coalesce(blank(r["normalized_invoice_number"]), tx.normalize_invoice_number(r["invoice_number"])).alias("normalized_invoice_number"),
            r["vendor_name"].alias("vendor_name"), tx.normalize_vendor_name(r["vendor_name"]).alias("normalized_vendor"),
            r["purchase_order"].alias("purchase_order"),
            tx.normalize_purchase_order(r["purchase_order"]).alias("normalized_purchase_order"),
            r["issue_date"].alias("issue_date"),
            money_decimal(F.coalesce(r["total"], r["invoice_total"])).alias("total"),
            money_decimal(r["applied_to_po"]).alias("applied_to_po"), r["status"].alias("status"), r["database"].alias("database"),
            F.coalesce(blank(r["document_id"]), blank(r["client_document_id"]), blank(r["vendor_document_id"])).alias("document_id"),
        ).cast(REFERENCE),
    )


def reference_key(r: Column) -> Column:
    return F.struct(*[r[c].alias(c) for c in ("database", "document_id", "normalized_invoice_number", "normalized_purchase_order")])


def previous_invoices(ctx: Column) -> Column:
    """References from the four places of raw context, first of each 4-key kept."""
    listed = lambda c: F.coalesce(c, F.slice(F.array(ctx["prior_invoice"]), 1, 0))
    raw = F.concat(
        F.array(ctx["prior_invoice"], ctx["previous_related_document"]),
        listed(ctx["client_database"]["previous_related_documents"]),
        listed(ctx["vendor_database"]["previous_related_documents"]),
    )
    refs = F.transform(F.filter(raw, lambda r: r.isNotNull()), invoice_reference)
    return F.aggregate(
        refs,
        F.slice(refs, 1, 0),
        lambda acc, r: F.when(
            F.exists(acc, lambda a: reference_key(a).eqNullSafe(reference_key(r))), acc
        ).otherwise(F.concat(acc, F.array(r))),
    )


def context_from_documents(docs: DataFrame) -> DataFrame:
    """Procurement context of manifest documents (column ``d``), with the usual defaults.

    Authorized and remaining amounts default to the invoice total, consumption to zero and the
    tolerance to 2% of the authorized amount.
    """
    d, raw = F.col("d"), F.col("d.ap_context.context")
    cand = raw["candidate_open_po"]
    md = money_decimal
    total = F.coalesce(md(raw["invoice_total"]), document_amount(d))
    authorized = F.coalesce(md(raw["po_authorized_total"]), md(cand["authorized_total"]), total)
    remaining = F.coalesce(md(raw["po_remaining_before_invoice"]), md(cand["remaining_balance"]), total)
    percent = F.coalesce(md(raw["tolerance_percent"]), F.lit("2.00").cast("decimal(12,2)"))
    tolerance = F.coalesce(md(raw["tolerance_amount"]), (authorized * percent / 100).cast("decimal(12,2)"))
    master = raw["vendor_master"]
    vendor_name = F.coalesce(tx.null_if_empty(master["vendor_name"]), d["seller"]["name"])
    po = F.coalesce(tx.null_if_empty(raw["po_number"]), tx.null_if_empty(d["purchase_order"]), cand["po_number"])
    first_code = F.coalesce(*[tx.null_if_empty(c) for c in (d["currency"], raw["currency"], raw["invoice_currency"], raw["po_currency"], raw["expected_currency"])])
    prior = raw["prior_invoice"]
    context = F.struct(
        F.coalesce(d["ap_context"]["scenario"], F.lit("manifest_document")).alias("scenario"),
        F.struct(
            vendor_name.alias("name"), tx.normalize_vendor_name(vendor_name).alias("normalized_name"),
            F.coalesce(F.filter(master["aliases"], lambda a: a != ""), F.expr("cast(array() as array<string>)")).alias("aliases"),
            master["vendor_id"].alias("vendor_id"), F.coalesce(tx.null_if_empty(master["tax_id"]), d["seller"]["tax_id"]).alias("tax_id"),
        ).alias("vendor"),
        F.struct(d["buyer"]["name"].alias("name"), tx.normalize_vendor_name(d["buyer"]["name"]).alias("normalized_name")).alias("buyer"),
        F.struct(
            d["invoice_number"].alias("invoice_number"), tx.normalize_invoice_number(d["invoice_number"]).alias("normalized_invoice_number"),
            d["issue_date"]["value"].alias("issue_date"), d["due_date"]["value"].alias("due_date"),
        ).alias("invoice"),
        first_code.alias("currency"),
        F.struct(
            F.coalesce(po, F.lit("")).alias("po_number"), tx.normalize_purchase_order(po).alias("normalized"),
            authorized.alias("authorized_total"),
            F.coalesce(md(raw["po_previously_consumed"]), F.lit(0).cast("decimal(12,2)")).alias("previously_consumed"),
            remaining.alias("remaining_before_invoice"),
        ).alias("purchase_order"),
        total.alias("invoice_total"),
        master["approved_bank_account"].alias("approved_bank_account"),
        F.struct(raw["invoice_payment"]["bank_account"].alias("bank_account"), raw["invoice_payment"]["remit_to"].alias("remit_to")).alias("invoice_payment"),
        F.coalesce(previous_invoices(raw), F.expr(f"cast(array() as array<{REFERENCE}>)")).alias("previous_invoices"),
        F.filter(F.array(invoice_reference(prior)), lambda r: r.isNotNull()).alias("duplicate_candidates"),
        F.when(cand.isNotNull(), F.struct(
            cand["po_number"].alias("po_number"), tx.normalize_purchase_order(cand["po_number"]).alias("normalized"),
            cand["vendor_name"].alias("vendor_name"), tx.normalize_vendor_name(cand["vendor_name"]).alias("normalized_vendor"),
            md(cand["authorized_total"]).alias("authorized_total"), md(cand["remaining_balance"]).alias("remaining_balance"),
        )).alias("candidate_open_po"),
        F.struct(percent.alias("percent"), tolerance.alias("amount")).alias("tolerance_policy"),
        F.transform_values(d["amounts"], lambda k, v: md(v["value"])).alias("amounts"),
        md(raw["variance_amount"]).alias("variance_amount"),
        d["ap_context"]["expected"]["decision"].alias("expected_decision"),
    ).cast(CONTEXT)
    return docs.withColumn("context", context)


def ap_records_from_documents(docs: DataFrame, owner: str) -> DataFrame:
    """AP records of manifest documents (columns ``d``, ``origin``)."""
    withctx = context_from_documents(docs)
    d = F.col("d")
    vendor = F.trim(F.coalesce("context.vendor.name", d["seller"]["name"], F.lit("")))
    blank = tx.null_if_empty
    return withctx.select(
        F.lit(owner).alias("owner_user_id"),
        F.concat_ws(":", F.lit("manifest"), F.coalesce(blank(F.col("origin")), F.lit("generated")),
                    F.coalesce(blank(d["document_id"]), blank(d["invoice_number"]), blank(d["purchase_order"]))).alias("source_key"),
        vendor.alias("vendor_name"), tx.normalize_vendor_name(vendor).alias("normalized_vendor"),
        blank(d["purchase_order"]).alias("purchase_order"),
        F.when(blank(d["purchase_order"]).isNotNull(), tx.normalize_purchase_order(d["purchase_order"])).alias("normalized_purchase_order"),
        blank(d["invoice_number"]).alias("invoice_number"),
        F.when(blank(d["invoice_number"]).isNotNull(), tx.normalize_invoice_number(d["invoice_number"])).alias("normalized_invoice_number"),
        F.coalesce("context.invoice_total", document_amount(d)).alias("invoice_total"),
        date_or_null(d["issue_date"]["value"]).alias("issue_date"),
        F.col("context.scenario").alias("scenario"), "context",
    )
