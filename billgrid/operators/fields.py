"""Field extraction from lines.

Most values stand on the label's own line, so candidates are read inside the row. Only labels
without a value there ask for lines around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billgrid.functions import lexicon as lx
from billgrid.functions import text as tx
from billgrid.functions.boxes import box, box_of_words, merge_box
from billgrid.functions.dates import parse_date, possible_dates
from billgrid.functions.money import currency_for_money, last_money, money_mentions
from billgrid.operators import grid
from billgrid.operators.candidates import best_candidate, stage, weak_geometry

EMPTY_TEXTS = "cast(array() as array<string>)"


def _record(df: DataFrame, *, confidence: Column, method: Column, reason: str, ceiling: float | None = None) -> DataFrame:
    """Shape rows with doc_id, field, page, seq, raw, value, bbox, label into candidates."""
    have = set(df.columns)
    return df.withColumn("confidence", F.round(confidence, 3)).select(
        "doc_id", "field", "seq", "raw", "value",
        (F.col("amount") if "amount" in have else F.lit(None).cast("double")).alias("amount"),
        (F.col("currency") if "currency" in have else F.lit(None).cast("string")).alias("currency"),
        "page", "bbox", "label", "confidence", method.alias("method"),
        weak_geometry(F.col("confidence")).alias("ambiguity_reasons"),
        F.lit(reason).alias("reason"), F.lit(ceiling).cast("double").alias("ceiling"),
    )


def _seq(*parts) -> Column:
    return F.array(*[p.cast("int") if isinstance(p, Column) else F.col(p).cast("int") for p in parts])


def _anchor_id() -> Column:
    return F.concat_ws("|", "doc_id", "page", "line_no", "field", F.col("h.start"), F.col("h.ord"))


# --- X1: scalars -----------------------------------------------------------------------


def scalar_candidates(lines: DataFrame) -> DataFrame:
    labelled = (
        lines.select(
            "doc_id", "page", "line_no", "words", "hits", "text", "x0", "top", "x1", "bottom",
            F.explode(
                F.filter(grid.drop_shadowed(F.col("hits")), lambda h: h["key"].isin(*lx.SCALAR_KEYS))
            ).alias("h"),
        )
        .withColumn("field", F.col("h.key"))
        .withColumn("anchor_id", _anchor_id())
        .withColumn("seq", _seq("page", "line_no", "h.ord", "h.start"))
        .withColumn("label", F.col("h.label"))
    )
    return _identifier_candidates(labelled, lines).unionByName(_value_candidates(labelled, lines))


def _confidence() -> Column:
    identifier = F.col("field").isin("invoice_number", "purchase_order")
    wordy = F.col("h.n") >= 2
    numberlike = (F.col("field") == "invoice_number") & tx.looks_like_invoice_number(F.col("value"))
    points = F.lit(92) + F.when(wordy, 3).otherwise(0) + F.when(numberlike, 3).otherwise(0) + F.when(identifier, 2).otherwise(0)
    return F.least(points / 100.0, F.lit(0.98))


def _identifier_candidates(labelled: DataFrame, lines: DataFrame) -> DataFrame:
    ids = stage(
        labelled.filter(F.col("field").isin("invoice_number", "purchase_order")),
        said=grid.value_words(F.col("words"), F.col("hits"), F.col("h")),
    )
    here = (
        stage(ids.filter(F.size("said") > 0), span=grid.leading_identifier(F.get("said", 0), F.get("said", 1)))
        .filter("span is not null")
        .select(
            "doc_id", "field", "page", "seq", "label", "h", F.col("span.raw").alias("raw"),
            F.col("span.value").alias("value"), F.col("span.bbox").alias("bbox"),
            F.lit("same_line").alias("way"),
        )
    )
    asks = ids.filter(F.size("said") == 0).select(
        "doc_id", "page", "anchor_id", "field", "seq", "label", "h", "top",
        F.get("words", F.col("h.start"))["x0"].alias("anchor_x"),
        ((F.col("top") + F.col("bottom")) / 2).alias("mid"),
    )
    found = grid.nearest_identifier(
        asks.select("doc_id", "page", "anchor_id", "field", "anchor_x", "mid", "top"), lines
    )
    around = asks.join(found, "anchor_id").select(
        "doc_id", "field", "page", "seq", "label", "h", "raw", "value", "bbox", F.col("method").alias("way")
    )
    both = here.unionByName(around).withColumn("raw", tx.clean_raw(F.col("raw")))
    return _record(
        both, confidence=_confidence(), method=F.concat(F.lit("label_"), "way"),
        reason="multiple_scalar_values", ceiling=0.95,
    )


def _value_candidates(labelled: DataFrame, lines: DataFrame) -> DataFrame:
    vals = stage(
        labelled.filter(F.col("field").isin("issue_date", "due_date", "terms")),
        said=grid.words_after(F.col("words"), F.col("h")),
    )
    own = F.col("text")
    cols = ["doc_id", "field", "page", "seq", "label", "h", "line_text", "raw", "bbox", "way"]
    here = vals.filter(F.size("said") > 0).select(
        "doc_id", "field", "page", "seq", "label", "h", own.alias("line_text"),
        grid.join_words(F.col("said")).alias("raw"), box_of_words(F.col("said")).alias("bbox"),
        F.lit("same_line").alias("way"),
    )
    asks = vals.filter(F.size("said") == 0)
    below = (
        grid.following_lines(
            asks.select("doc_id", "page", "anchor_id", "bottom"),
            lines.select("doc_id", "page", "line_no", "text", "x0", "top", "x1", "bottom", "hits"), 32, 2,
        )
        .filter(F.size("hits") == 0)
        .groupBy("anchor_id")
        .agg(F.min_by(F.struct("text", box(*[F.col(c) for c in ("x0", "top", "x1", "bottom")]).alias("bbox")), "k").alias("b"))
    )
    under = asks.join(below, "anchor_id", "left").select(
        "doc_id", "field", "page", "seq", "label", "h", own.alias("line_text"),
        F.coalesce("b.text", F.lit("")).alias("raw"),
        F.coalesce("b.bbox", box(*[F.col(c) for c in ("x0", "top", "x1", "bottom")])).alias("bbox"),
        F.when(F.col("b").isNull(), "same_line").otherwise("below").alias("way"),
    )
    both = stage(here.select(*cols).unionByName(under.select(*cols)), raw=tx.clean_raw(F.col("raw")))
    day = F.coalesce(parse_date(F.col("raw")), parse_date(F.col("line_text")))
    dated = stage(both.filter("field != 'terms'"), d=day).filter("d is not null").withColumn(
        "raw", F.col("d.raw")
    ).withColumn("value", F.col("d.value"))
    terms = both.filter("field = 'terms'").withColumn("raw", tx.trim_at_known_label(F.col("raw")))
    terms = stage(terms, value=tx.scalar_value("terms", F.col("raw"))).filter("value is not null")
    rows = dated.drop("d").unionByName(terms)
    return _record(
        rows, confidence=_confidence(), method=F.concat(F.lit("label_"), "way"),
        reason="multiple_scalar_values", ceiling=0.95,
    )


def extract_scalars(lines: DataFrame) -> DataFrame:
    """X1 with both dates resolved against each other."""
    return resolve_dates(best_candidate(scalar_candidates(lines)))


def resolve_dates(fields: DataFrame) -> DataFrame:
    """Choose the readings of issue and due date that fit together.

    Valid pairs are 0 to 366 days apart; up to 120 days is preferred, then the shortest.
    Both dates have at most two readings, so the pairs stay inside the row.
    """
    raws = fields.filter(F.col("field").isin("issue_date", "due_date")).groupBy("doc_id").agg(
        F.max(F.when(F.col("field") == "issue_date", F.col("raw"))).alias("i"),
        F.max(F.when(F.col("field") == "due_date", F.col("raw"))).alias("d"),
    ).filter("i is not null and d is not null")
    issue, due = possible_dates(F.col("i")), possible_dates(F.col("d"))
    pairs = F.flatten(
        F.transform(
            "issues",
            lambda a, i: F.transform("dues", lambda b, j: F.struct(
                F.when(F.datediff(b, a) <= 120, 0).otherwise(1).alias("far"), F.datediff(b, a).alias("days"),
                i.alias("i"), j.alias("j"), a.alias("issue"), b.alias("due"),
            )),
        )
    )
    chosen = (
        raws.select("doc_id", issue.alias("issues"), due.alias("dues"))
        .withColumn("p", F.array_min(F.filter(pairs, lambda p: p["days"].between(0, 366))))
        .filter("p is not null")
        .select("doc_id", F.explode(F.array(
            F.struct(F.lit("issue_date").alias("field"), F.col("p.issue").cast("string").alias("day")),
            F.struct(F.lit("due_date").alias("field"), F.col("p.due").cast("string").alias("day")),
        )).alias("c"))
        .select("doc_id", "c.field", "c.day")
    )
    change = F.col("day").isNotNull() & ~F.col("value").eqNullSafe(F.col("day"))
    return (
        fields.join(chosen, ["doc_id", "field"], "left")
        .withColumn("method", F.when(change, F.concat(F.lit("date_order_resolved:"), "method")).otherwise(F.col("method")))
        .withColumn("confidence", F.when(change, F.greatest("confidence", F.lit(0.93))).otherwise(F.col("confidence")))
        .withColumn("value", F.coalesce("day", "value"))
        .drop("day")
    )


# --- X2: money -------------------------------------------------------------------------


def is_money_part(w: Column) -> Column:
    return w["money"] | w["cur"] | w["num"]


def rightmost_money(words: Column) -> Column:
    """The amount furthest right: ``struct<raw, amount, currency, bbox, x1>`` or NULL.

    Amounts may span up to three words that are close together ("USD", "1 200", ",50").
    """

    def best(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda w, i: F.struct(is_money_part(w).alias("p"), i.alias("i"))), lambda s: s["p"]
        )
        near = lambda left, right: right.isNotNull() & is_money_part(right) & (right["x0"] - left["x1"] <= 20.0)

        def spans(run: Column) -> Column:
            two = near(run[0], F.get(run, 1))
            three = two & near(F.get(run, 1), F.get(run, 2))
            n = F.when(three, 3).when(two, 2).otherwise(1)
            return F.transform(F.sequence(F.lit(1), n), lambda k: F.slice(run, F.lit(1), k))

        groups = F.flatten(
            F.transform(starts, lambda s: tx.let(F.slice(ordered, s["i"] + 1, F.lit(3)), spans))
        )
        scored = F.transform(
            groups,
            lambda g, n: F.struct(
                F.array_max(F.transform(g, lambda w: w["x1"])).alias("x1"), F.size(g).alias("n"), (-n).alias("first"),
                last_money(grid.words_text(g)).alias("money"), g.alias("g"),
            ),
        )
        return F.array_max(F.filter(scored, lambda s: s["money"].isNotNull()))

    shaped = tx.let(
        tx.let(F.sort_array(words), best),
        lambda b: F.when(
            b.isNotNull(),
            F.struct(
                b["money"]["raw"].alias("raw"), b["money"]["amount"].alias("amount"), b["money"]["currency"].alias("currency"),
                box_of_words(b["g"]).alias("bbox"), b["x1"].alias("x1"),
            ),
        ),
    )
    return F.when(F.exists(words, is_money_part), shaped)


def money_candidates(lines: DataFrame) -> DataFrame:
    """One candidate per line and money field it names."""
    total = F.array_min(
        F.transform("words", lambda w, i: F.when(w["tok"] == "total", i))
    )
    total_hit = F.when(
        total.isNotNull(),
        F.struct(
            F.lit("balance_due").alias("key"), F.lit("total").alias("label"), F.lit(0).alias("ord"),
            F.lit(1).alias("n"), total.alias("start"), (total + 1).alias("end"),
        ),
    )
    picks = [grid.first_label(F.col("hits"), k) for k in lx.MONEY_KEYS[:-1]]
    picks.append(F.coalesce(grid.first_label(F.col("hits"), "balance_due"), total_hit))
    rows = (
        lines.filter(F.col("text").rlike(r"\d"))
        .select(
            "doc_id", "page", "line_no", "words", "text", "x0", "top", "x1", "bottom",
            F.explode(F.array_compact(F.array(*picks))).alias("h"),
        )
        .withColumn("field", F.col("h.key"))
        .withColumn("label", F.col("h.label"))
        .withColumn("seq", _seq("page", "line_no"))
        .withColumn("behind", F.slice("words", F.col("h.end") + 1, F.size("words")))
    )
    rows = stage(
        rows, span=rightmost_money(F.filter("behind", lambda w: (w["tok"] != "") | w["cur"])),
        said=F.filter("behind", lambda w: w["tok"] != ""),
    )
    by_line = F.coalesce(last_money(grid.join_words(F.col("said"))), last_money(F.col("text")))
    rows = stage(rows, loose=F.when(F.col("span").isNull(), by_line)).filter("span is not null or loose is not null")
    generic = (F.col("field") == "balance_due") & (F.col("label") == "total")
    corner = F.when(grid.is_bottom_or_right(F.col("top"), F.col("x0")), 4).otherwise(0)
    by_words = F.when(generic, 76).otherwise(92)
    by_text = F.when(generic, 72).otherwise(90)
    found = F.col("span").isNotNull()
    confidence = F.least((F.when(found, by_words).otherwise(by_text) + corner) / 100.0, F.lit(0.98))
    own_box = box(*[F.col(c) for c in ("x0", "top", "x1", "bottom")])
    shaped = (
        rows.withColumn("raw", F.coalesce("span.raw", "loose.raw"))
        .withColumn("amount", F.bround(F.coalesce("span.amount", "loose.amount"), 2))
        .withColumn("currency", F.when(found, F.col("span.currency")).otherwise(F.col("loose.currency")))
        .withColumn("value", F.col("amount").cast("string"))
        .withColumn("bbox", F.coalesce("span.bbox", box_of_words(F.col("said")), own_box))
    )
    out = _record(
        shaped, confidence=confidence,
        method=F.when(found, "money_label_words").otherwise("money_label_same_line"), reason="multiple_amounts",
    )
    return out.withColumn(
        "reason", F.when(F.col("field") == "balance_due", "multiple_totals").otherwise(F.col("reason"))
    )


def extract_money(lines: DataFrame) -> DataFrame:
    return best_candidate(money_candidates(lines))


def fill_currency(fields: DataFrame, currencies: DataFrame) -> DataFrame:
    """money without its own currency takes the document's."""
    doc = currencies.select("doc_id", F.col("value").alias("_doc_currency"))
    known = F.col("_doc_currency")
    out = fields.join(doc, "doc_id", "left").withColumn(
        "currency", F.when(F.col("amount").isNotNull(), currency_for_money(F.struct("raw", "currency"), known))
    )
    if "alternatives" in fields.columns:
        out = out.withColumn(
            "alternatives",
            F.transform(
                "alternatives",
                lambda a: a.withField("currency", F.when(a["amount"].isNotNull(), currency_for_money(a, known))),
            ),
        )
    return out.drop("_doc_currency")


# --- A4 / X7: currency -----------------------------------------------------------------


def infer_currency(lines: DataFrame) -> DataFrame:
    """Most frequent currency over all amounts of a document; else the first code in its text."""
    place = F.struct("page", "line_no")
    own_box = box(*[F.col(c) for c in ("x0", "top", "x1", "bottom")])
    counted = (
        lines.select(
            "doc_id", "page", "line_no", own_box.alias("bbox"),
            F.posexplode(F.filter(money_mentions(F.col("text")), lambda m: m["currency"].isNotNull())).alias("pos", "m"),
        )
        .groupBy("doc_id", F.col("m.currency").alias("value"))
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("page", "line_no", "pos", F.col("m.raw").alias("raw"), "bbox")).alias("f"),
        )
        .groupBy("doc_id")
        .agg(F.max_by(
            F.struct("value", "n", "f"),
            F.struct("n", (-F.col("f.page")).alias("p"), (-F.col("f.line_no")).alias("l"), (-F.col("f.pos")).alias("q")),
        ).alias("b"))
        .select(
            "doc_id", F.col("b.f.raw").alias("raw"), F.col("b.value").alias("value"),
            F.col("b.f.page").alias("page"), F.col("b.f.bbox").alias("bbox"),
            F.least(F.lit(0.72) + F.col("b.n") * 0.03, F.lit(0.93)).alias("confidence"),
            F.lit("money_currency_frequency").alias("method"),
        )
    )
    codes = [*lx.CURRENCY_CODES, "RMB"]
    written = F.array_compact(
        F.array(*[F.when(F.col("text").rlike(rf"(?i)\b{c}\b"), F.lit(c)) for c in codes])
    )
    by_text = (
        lines.filter(F.col("text").rlike(r"(?i)\b(?:" + "|".join(codes) + r")\b"))
        .select("doc_id", "page", "line_no", own_box.alias("bbox"), F.get(written, 0).alias("raw"))
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("raw", "page", "bbox"), place).alias("b"))
        .join(counted.select("doc_id"), "doc_id", "left_anti")
        .select(
            "doc_id", "b.raw", F.when(F.col("b.raw") == "RMB", "CNY").otherwise(F.col("b.raw")).alias("value"),
            "b.page", "b.bbox", F.lit(0.58).alias("confidence"),
            F.when(F.col("b.raw") == "RMB", "currency_alias_text").otherwise("currency_code_text").alias("method"),
        )
    )
    return counted.unionByName(by_text)


def extract_currency(lines: DataFrame) -> DataFrame:
    return infer_currency(lines).select(
        "doc_id", F.lit("currency").alias("field"), "raw", "value", F.lit(None).cast("double").alias("amount"),
        F.lit(None).cast("string").alias("currency"), "page", "bbox", F.lit("currency").alias("label"),
        F.round("confidence", 3).alias("confidence"), "method",
        weak_geometry(F.col("confidence")).alias("ambiguity_reasons"),
    )


# --- X3, X4: blocks --------------------------------------------------------------------


def _gap_boundary(words: Column) -> Column:
    """Middle of the first wide gap between neighbouring words, or NULL."""
    return F.array_min(
        F.transform(
            words,
            lambda w, i: F.when(
                (i > 0)
                & (w["x0"] - F.get(words, F.greatest(i - 1, F.lit(0)))["x1"] > 72)
                & (w["x0"] - F.get(words, 0)["x0"] > 110),
                F.struct(i.alias("i"), ((F.get(words, F.greatest(i - 1, F.lit(0)))["x1"] + w["x0"]) / 2).alias("x")),
            ),
        )
    )["x"]


def party_hit(words: Column, hits: Column, line_x0: Column, key: str) -> Column:
    """The label that opens a party block on a line, or NULL."""
    party_labels = [*lx.FIELD_LABELS["seller"], *lx.FIELD_LABELS["buyer"]]

    def opens(h: Column) -> Column:
        here, prev = F.get(words, h["start"]), F.get(words, F.greatest(h["start"] - 1, F.lit(0)))
        return F.when(h["start"] == 0, here["x0"] - line_x0 <= 3.0).otherwise(
            (here["x0"] - prev["x1"] > 72.0) & (here["x0"] - line_x0 > 80.0)
        )

    def taken(h: Column) -> Column:
        return F.exists(
            hits,
            lambda o: ~o["key"].isin("seller", "buyer") & (o["start"] == h["start"]) & (o["end"] > h["end"])
            & ~o["label"].isin(*party_labels),
        )

    ranked = F.transform(
        F.filter(hits, lambda h: (h["key"] == key) & opens(h) & ~taken(h)),
        lambda h: F.struct(
            h["start"].alias("a"), (-h["n"]).alias("b"),
            F.when(h["label"].isin(*lx.AMBIGUOUS_PARTY_LABELS), 1).otherwise(0).alias("c"), h["ord"].alias("d"), h.alias("h"),
        ),
    )
    return F.array_min(ranked)["h"]


STOP_KEYS = (
    "invoice_number", "issue_date", "due_date", "purchase_order", "terms", "payment_instructions",
    *lx.MONEY_KEYS,
)


def party_candidates(lines: DataFrame) -> DataFrame:
    """Blocks under seller and buyer labels, cropped to the label's column."""
    w, hits = F.col("words"), F.col("hits")
    opened = F.array_compact(
        F.array(party_hit(w, hits, F.col("x0"), "seller"), party_hit(w, hits, F.col("x0"), "buyer"))
    )
    asks = (
        lines.filter(F.exists("hits", lambda h: h["key"].isin("seller", "buyer")))
        .select("doc_id", "page", "line_no", "words", "x0", "bottom", "page_x1", F.explode(opened).alias("h"))
        .withColumn("field", F.col("h.key"))
        .withColumn("anchor_id", _anchor_id())
        .withColumn("own_right", _gap_boundary(F.slice("words", F.col("h.end"), F.size("words"))))
        .withColumn("left", F.greatest(F.lit(0.0), F.get("words", F.col("h.start"))["x0"] - 8.0))
        .withColumn("label_words", F.slice("words", F.col("h.start") + 1, F.col("h.n")))
    )
    near = grid.following_lines(
        asks.select("doc_id", "page", "anchor_id", "bottom"),
        lines.select("doc_id", "page", "line_no", "words", "x0", "top", "x1", "bottom"), 72, 5,
    ).select("anchor_id", "k", F.col("words").alias("cand"), F.col("x0").alias("cx0"))
    # the first close follower with a wide gap bounds the column when the label line does not
    edge = F.min(
        F.when((F.abs(F.col("cx0") - F.col("x0")) <= 8) & F.col("cgap").isNotNull(), F.struct("k", "cgap"))
    ).over(Window.partitionBy("anchor_id"))
    joined = (
        asks.join(near.withColumn("cgap", _gap_boundary(F.col("cand"))), "anchor_id", "left")
        .withColumn("edge", edge)
        .withColumn(
            "right",
            F.coalesce("own_right", "edge.cgap", F.least(F.col("x0") + 260.0, F.col("page_x1"))),
        )
    )
    # followers cropped to the column; every test on them is independent of the others
    crop = F.filter("cand", lambda c: (c["x0"] >= F.col("left")) & ((c["x0"] + c["x1"]) / 2 < F.col("right")))
    rows = stage(joined, crop=F.coalesce(crop, F.slice("words", 1, 0)))
    rows = stage(rows, chits=grid.label_hits(F.col("crop")))
    ctext = grid.join_words(F.col("crop"))
    cx0 = F.array_min(F.transform("crop", lambda c: c["x0"]))
    cx1 = F.array_max(F.transform("crop", lambda c: c["x1"]))
    lx0 = F.array_min(F.transform("label_words", lambda c: c["x0"]))
    lx1 = F.array_max(F.transform("label_words", lambda c: c["x1"]))
    at_start = lambda keys: F.exists("chits", lambda h: (h["start"] == 0) & h["key"].isin(*keys))
    again = F.when(F.col("field") == "seller", party_hit(F.col("crop"), F.col("chits"), cx0, "seller").isNotNull()).otherwise(
        party_hit(F.col("crop"), F.col("chits"), cx0, "buyer").isNotNull()
    )
    stops = again | at_start(STOP_KEYS) | ((F.col("field") == "seller") & at_start(["buyer"])) | tx.has_table_header_text(ctext)
    filled = F.size("crop") > 0
    away = (F.abs(cx0 - F.col("x0")) > 42) & ~grid.overlaps_x(cx0, cx1, lx0, lx1)
    blocks = (
        rows.withColumn("stop_k", F.when(filled & F.coalesce(stops, F.lit(False)), F.col("k")))
        .withColumn(
            "part",
            F.when(filled & ~F.coalesce(away, F.lit(False)), F.struct("k", ctext.alias("text"), box_of_words(F.col("crop")).alias("bbox"))),
        )
        .groupBy("anchor_id")
        .agg(
            F.first(F.struct("doc_id", "page", "line_no", "field", "words", "h", "left", "right", "label_words")).alias("a"),
            F.min("stop_k").alias("stop_k"),
            F.sort_array(F.collect_list("part")).alias("parts"),
        )
    )
    same = F.filter(
        F.slice("a.words", F.col("a.h.end") + 1, F.size("a.words")),
        lambda c: (c["tok"] != "") & (c["x0"] >= F.col("a.left")) & (c["x0"] < F.col("a.right")),
    )
    blocks = (
        blocks.withColumn("same", same)
        .withColumn("own", F.when(F.size("same") > 0, F.array(F.struct(F.lit(0).alias("k"), grid.join_words(F.col("same")).alias("text"), box_of_words(F.col("same")).alias("bbox")))).otherwise(F.slice("parts", 1, 0)))
        .withColumn("kept", F.concat("own", F.filter("parts", lambda p: F.col("stop_k").isNull() | (p["k"] < F.col("stop_k")))))
        .withColumn("raw", F.trim(F.array_join(F.transform("kept", lambda p: p["text"]), "\n")))
        .filter("raw != ''")
        .select(
            F.col("a.doc_id").alias("doc_id"), F.col("a.field").alias("field"), F.col("a.page").alias("page"),
            _seq("a.page", "a.line_no").alias("seq"), "raw", F.col("raw").alias("value"),
            F.col("a.h.label").alias("label"),
            F.aggregate("kept", box_of_words(F.col("a.label_words")), lambda b, p: merge_box(b, p["bbox"])).alias("bbox"),
            F.size("kept").alias("n"),
        )
    )
    ambiguous = F.col("label").isin(*lx.AMBIGUOUS_PARTY_LABELS)
    flat = F.trim(F.translate("raw", "\n", " "))
    vague = (
        blocks.filter(ambiguous).withColumn("_flat", flat)
        .withColumn("_toks", F.filter(F.transform(F.split("_flat", " "), lambda t: tx.canonical(t)), lambda t: t != ""))
        .filter(~_low_quality_party()).drop("_flat", "_toks")
    )
    blocks = blocks.filter(~ambiguous).unionByName(vague)
    points = F.when(ambiguous, 80).otherwise(86) + F.when(F.col("n") > 1, 3).otherwise(0)
    return _record(
        blocks, confidence=F.least(points / 100.0, F.lit(0.92)), method=F.lit("party_block"), reason="label_collision"
    )


def _low_quality_party() -> Column:
    """A block under a vague label that reads like a number, a date or a total."""
    flat, toks = F.col("_flat"), F.col("_toks")
    letters = F.length(F.regexp_replace(flat, "[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace(flat, r"\D", ""))
    return (
        F.coalesce(F.get(toks, 0).isin(*lx.PARTY_NOISE_TOKENS), F.lit(True))
        | parse_date(flat).isNotNull()
        | tx.has_total_text(flat)
        | ((F.size(money_mentions(flat)) > 0) & (F.size(toks) <= 4))
        | (letters < 3)
        | ((digits > letters) & (F.size(toks) <= 3))
        | ((F.size(toks) == 1) & (F.length(F.get(toks, 0)) <= 3))
    )


def extract_parties(lines: DataFrame) -> DataFrame:
    """Seller and buyer blocks."""
    return with_seller_fallback(best_candidate(party_candidates(lines)), lines)


def with_seller_fallback(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """The top of the page stands in for a seller no label names."""
    own_box = box(*[F.col(c) for c in ("x0", "top", "x1", "bottom")])
    top = (
        lines.filter((F.col("top") <= 160) & (F.size("hits") == 0) & (F.length("text") >= 3))
        .filter(~tx.canonical(F.col("text")).isin(*lx.TITLE_WORDS))
        .groupBy("doc_id")
        .agg(F.min(F.struct("page", "line_no", "text", own_box.alias("bbox"))).alias("b"))
        .join(fields.filter("field = 'seller'").select("doc_id"), "doc_id", "left_anti")
        .select(
            "doc_id", F.lit("seller").alias("field"), F.col("b.text").alias("raw"), F.col("b.text").alias("value"),
            F.col("b.page").alias("page"), F.col("b.bbox").alias("bbox"), F.lit(0.45).alias("confidence"),
            F.lit("top_page_fallback").alias("method"), F.array(F.lit("weak_geometry")).alias("ambiguity_reasons"),
        )
    )
    return fields.unionByName(top, allowMissingColumns=True)


def payment_candidates(lines: DataFrame) -> DataFrame:
    """Blocks under payment labels."""
    asks = (
        lines.select(
            "doc_id", "page", "line_no", "words", "x0", "top", "x1", "bottom",
            grid.first_label(F.col("hits"), "payment_instructions").alias("h"),
        )
        .filter("h is not null")
        .withColumn("field", F.lit("payment_instructions"))
        .withColumn("anchor_id", _anchor_id())
    )
    stop = grid.is_total_line(F.col("words"), F.col("hits")) | tx.has_table_header_text(F.col("text"))
    near = grid.following_lines(
        asks.select("doc_id", "page", "anchor_id", "bottom"),
        lines.select("doc_id", "page", "line_no", "text", "x0", "top", "x1", "bottom", stop.alias("stop")), 54, 4,
    ).select(
        "anchor_id", "k", "stop", F.col("text").alias("ctext"), F.col("x0").alias("cx0"), F.col("x1").alias("cx1"),
        box(*[F.col(c) for c in ("x0", "top", "x1", "bottom")]).alias("cbox"),
    )
    away = (F.abs(F.col("cx0") - F.col("x0")) > 50) & ~grid.overlaps_x(F.col("cx0"), F.col("cx1"), F.col("x0"), F.col("x1"))
    own_box = box(*[F.col(c) for c in ("x0", "top", "x1", "bottom")])
    said = grid.words_after(F.col("words"), F.col("h"))
    blocks = (
        asks.join(near, "anchor_id", "left")
        .groupBy("anchor_id")
        .agg(
            F.first(F.struct("doc_id", "page", "line_no", "h", said.alias("said"), own_box.alias("bbox"))).alias("a"),
            F.min(F.when(F.col("stop"), F.col("k"))).alias("stop_k"),
            F.sort_array(F.collect_list(F.when(~away, F.struct("k", F.col("ctext").alias("text"), F.col("cbox").alias("bbox"))))).alias("parts"),
        )
        .withColumn("own", F.when(F.size("a.said") > 0, F.array(F.struct(F.lit(0).alias("k"), grid.join_words(F.col("a.said")).alias("text"), box_of_words(F.col("a.said")).alias("bbox")))).otherwise(F.slice("parts", 1, 0)))
        .withColumn("kept", F.concat("own", F.filter("parts", lambda p: F.col("stop_k").isNull() | (p["k"] < F.col("stop_k")))))
        .withColumn("raw", F.trim(F.array_join(F.transform("kept", lambda p: p["text"]), "\n")))
        .filter("raw != ''")
        .select(
            F.col("a.doc_id").alias("doc_id"), F.lit("payment_instructions").alias("field"), F.col("a.page").alias("page"),
            _seq("a.page", "a.line_no").alias("seq"), "raw", F.col("raw").alias("value"), F.col("a.h.label").alias("label"),
            F.aggregate("kept", F.col("a.bbox"), lambda b, p: merge_box(b, p["bbox"])).alias("bbox"),
        )
    )
    return _record(blocks, confidence=F.lit(0.82), method=F.lit("payment_block"), reason="multiple_payment_blocks")


def extract_payment(lines: DataFrame) -> DataFrame:
    return best_candidate(payment_candidates(lines))


# --- W13: balance ----------------------------------------------------------------------


def resolve_balance(fields: DataFrame, item_sums: DataFrame) -> DataFrame:
    """Among the readings of the balance take the one the other amounts add up to.

    ``item_sums`` (doc_id, item_sum) stands in for a missing subtotal.
    """
    pick = lambda k: F.max(F.when(F.col("field") == k, F.col("amount")))
    sums = (
        fields.filter(F.col("field").isin(*lx.MONEY_KEYS)).groupBy("doc_id")
        .agg(*[pick(k).alias(k) for k in lx.MONEY_KEYS])
        .join(item_sums.select("doc_id", "item_sum"), "doc_id", "left")
        .withColumn("base", F.coalesce("subtotal", "item_sum"))
        .filter("base is not null and balance_due is not null")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sums = sums.select(
        "doc_id",
        (F.col("base") - F.abs(zero("discount")) + zero("tax") + zero("shipping") - zero("paid")).alias("expected"),
    ).withColumn("field", F.lit("balance_due"))
    joined = fields.join(sums, ["doc_id", "field"], "left")
    record = ["raw", "value", "amount", "currency", "page", "bbox", "label", "confidence", "method"]
    me = F.struct(*record)
    options = F.filter(
        F.concat(F.array(me), F.coalesce(F.col("alternatives"), F.slice(F.array(me), 1, 0))), lambda a: a["amount"].isNotNull()
    )
    best = F.array_min(
        F.transform("_options", lambda a, i: F.struct(F.abs(a["amount"] - F.col("expected")).alias("d"), i.alias("i"), a.alias("a")))
    )
    joined = stage(stage(joined, _options=F.when(F.col("expected").isNotNull(), options)), _b=best)
    fits = F.coalesce(F.col("_b.d") <= F.greatest(F.lit(0.02), F.abs("expected") * 0.001), F.lit(False))
    rest = F.filter("_options", lambda a: a["amount"] != F.col("_b.a.amount"))
    # an alternative that wins had its reasons removed; a winner keeps all but the settled ones
    reasons = F.when(F.col("_b.i") > 0, F.expr(EMPTY_TEXTS)).otherwise(
        F.array_except("ambiguity_reasons", F.array(F.lit("multiple_totals"), F.lit("weak_geometry")))
    )
    changed = {
        "raw": F.col("_b.a.raw"), "value": F.col("_b.a.value"), "amount": F.col("_b.a.amount"),
        "currency": F.col("_b.a.currency"), "page": F.col("_b.a.page"), "bbox": F.col("_b.a.bbox"),
        "label": F.col("_b.a.label"), "confidence": F.greatest(F.col("_b.a.confidence"), F.lit(0.93)),
        "method": F.concat(F.lit("constraint_resolved:"), F.col("_b.a.method")),
        "ambiguity_reasons": reasons, "alternatives": F.when(F.size(rest) > 0, rest),
    }
    keep = [c for c in fields.columns]
    return joined.withColumn("_fits", fits).select(
        *[
            F.when(F.col("_fits"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in keep
        ]
    )
