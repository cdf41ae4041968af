"""From page words to visual lines and labels.

The unit of work is one physical page, keyed by ``(doc_id, page)``: long documents spread
over many keys. Words are brought together by one shuffle; splitting into lines, line
numbering and page extents reuse that partitioning.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billgrid.functions import lexicon as lx
from billgrid.functions import text as tx
from billgrid.functions.boxes import box_of_words
from billgrid.functions.money import has_money
from billgrid.operators.candidates import stage

#: fields of a word inside a line; their order makes arrays sort top-down, left to right
WORD_FIELDS = ("top", "x0", "x1", "bottom", "text", "confidence")


def annotate_words(words: Column) -> Column:
    """Words of a line with facts that follow from their text: whoever doesn't read the words doesn't pay for
    them, and they are neither moved nor sorted."""
    def known(w: Column) -> Column:
        t = w["text"]
        return F.struct(
            *[w[f].alias(f) for f in WORD_FIELDS],
            tx.canonical(t).alias("tok"),
            tx.header_token(t).alias("htok"),
            has_money(t).alias("money"),
            tx.is_currency_word(t).alias("cur"),
            tx.is_number_word(t).alias("num"),
        )

    return F.transform(words, known)


def token_words(words: Column) -> Column:
    """Words of a line with what labels are found by, for those who read the labels only."""
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), tx.canonical(w["text"]).alias("tok")))


def build_lines(words: DataFrame, factor: float = 0.55, keys=("doc_id", "page"), facts=annotate_words) -> DataFrame:
    """Group words into visual lines; ``facts`` says what is known of their words.

    A word joins the current line when its middle is within ``max(3.2, factor * height)`` of
    the line's running mean. That rule is sequential, but two facts settle almost every word
    without it: a word further than its tolerance below everything seen so far always starts
    a line, and words that all lie within the tolerance of each other always share one. Only
    runs that neither fact decides are folded word by word.
    """
    keys = list(keys)
    mid = (F.col("top") + F.col("bottom")) / 2
    tol = F.greatest(F.lit(3.2), (F.col("bottom") - F.col("top")) * factor)
    reading = Window.partitionBy(*keys).orderBy("top", "x0", "x1", "bottom", "text")
    before = reading.rowsBetween(Window.unboundedPreceding, -1)
    deepest = F.max("_mid").over(before)
    starts = F.when(deepest.isNull() | (F.col("_mid") - deepest > F.col("_tol")), 1).otherwise(0)
    runs = (
        words.withColumn("_mid", mid)
        .withColumn("_tol", tol)
        .withColumn("_start", starts)
        .withColumn("_run", F.sum("_start").over(reading.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(
            F.sort_array(F.collect_list(F.struct(*WORD_FIELDS))).alias("words"),
            (F.max("_mid") - F.min("_mid")).alias("_spread"),
            F.min("_tol").alias("_tol"),
        )
    )

    def step(acc: Column, w: Column) -> Column:
        m = (w["top"] + w["bottom"]) / 2
        t = F.greatest(F.lit(3.2), (w["bottom"] - w["top"]) * factor)
        joins = (acc["n"] > 0) & (F.abs(m - acc["total"] / acc["n"]) <= t)
        return F.struct(
            F.when(joins, acc["total"] + m).otherwise(m).alias("total"),
            F.when(joins, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
            (acc["pos"] + 1).alias("pos"),
            F.when(joins, acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(acc["pos"]))).alias("cuts"),
        )

    zero = F.struct(
        F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("pos"),
        F.expr("cast(array() as array<int>)").alias("cuts"),
    )
    cuts = F.when(F.col("_spread") <= F.col("_tol"), F.array(F.lit(0))).otherwise(
        F.aggregate("words", zero, step)["cuts"]
    )
    pieces = runs.select(*keys, "words", cuts.alias("_cuts")).select(
        *keys, "words", "_cuts", F.posexplode("_cuts").alias("_i", "_from")
    )
    upto = F.coalesce(F.get("_cuts", F.col("_i") + 1), F.size("words"))
    piece = F.slice("words", F.col("_from") + 1, upto - F.col("_from"))
    by_x = F.transform(
        F.sort_array(F.transform(piece, lambda w: F.struct(w["x0"].alias("x"), w.alias("w")))),
        lambda s: s["w"],
    )
    # staged: the text, its test and the words would each sort again
    lines = stage(pieces.select(*keys, "words", "_cuts", "_i", "_from"), words=by_x).select(*keys, "words")
    return number_lines(with_extent(lines), keys).withColumn("words", facts(F.col("words")))


def with_extent(lines: DataFrame) -> DataFrame:
    """Text and extent of each line; lines without visible text are dropped."""
    def edge(name: str) -> Column:
        return F.transform("words", lambda w: w[name])

    return lines.select(
        "*",
        F.trim(F.array_join(edge("text"), " ")).alias("text"),
        F.array_min(edge("x0")).alias("x0"),
        F.array_min(edge("top")).alias("top"),
        F.array_max(edge("x1")).alias("x1"),
        F.array_max(edge("bottom")).alias("bottom"),
    ).filter(F.col("text") != "")


def number_lines(lines: DataFrame, keys) -> DataFrame:
    """Line numbers from 1 in (top, x0) order, and the right edge of the page's text."""
    page = Window.partitionBy(*keys)
    return lines.withColumn(
        "line_no", F.row_number().over(page.orderBy("top", "x0", "x1", "bottom", "text"))
    ).withColumn("page_x1", F.max("x1").over(page))


# --- phrases in token arrays -----------------------------------------------------------


class Phrases:
    """A dictionary of token phrases looked up inside a line, without leaving the row."""

    def __init__(self, entries: list[tuple[list[str], str, str, int]]):
        """``entries``: (tokens, key, label, rank of the label within its key)."""
        self.by_phrase: dict[str, list[dict]] = {}
        for tokens, key, label, rank in entries:
            self.by_phrase.setdefault(" ".join(tokens), []).append(
                {"key": key, "label": label, "ord": rank, "n": len(tokens)}
            )
        self.lengths = sorted({len(p.split(" ")) for p in self.by_phrase})
        self.firsts = sorted({p.split(" ")[0] for p in self.by_phrase})

    def hits(self, words: Column, token: str = "tok") -> Column:
        """``array<struct<key, label, ord, n, start, end>>``, 0-based and end-exclusive."""
        table = F.from_json(
            F.lit(json.dumps(self.by_phrase)),
            "map<string,array<struct<key:string,label:string,ord:int,n:int>>>",
        )
        places = F.filter(
            F.transform(words, lambda w, i: F.struct(w[token].alias("t"), i.alias("i"))),
            lambda p: p["t"].isin(*self.firsts),
        )

        def at(p: Column) -> Column:
            # only the few words a phrase can span are looked at, whatever the line's length
            def gram(n: int) -> Column:
                return F.array_join(F.transform(F.slice(words, p["i"] + 1, F.lit(n)), lambda w: w[token]), " ")

            grams = F.array(*[gram(n) for n in self.lengths])
            # near the end of a line the longer grams shrink to shorter ones: look up once
            known = F.filter(F.array_distinct(grams), lambda g: g.isin(*self.by_phrase))
            return F.flatten(
                F.transform(
                    known,
                    lambda g: F.transform(
                        F.element_at(table, g),
                        lambda h: F.struct(
                            h["key"].alias("key"), h["label"].alias("label"), h["ord"].alias("ord"),
                            h["n"].alias("n"), p["i"].alias("start"), (p["i"] + h["n"]).alias("end"),
                        ),
                    ),
                )
            )

        return F.flatten(F.transform(places, at))


def field_phrases(labels=lx.FIELD_LABELS) -> Phrases:
    return Phrases(
        [
            (tx.phrase_words(label), key, label, rank)
            for key, phrases in labels.items()
            for rank, label in enumerate(phrases)
            if tx.phrase_words(label)
        ]
    )


def label_hits(words: Column, labels=lx.FIELD_LABELS) -> Column:
    """All label matches of a line. Labels with ``#`` need a literal ``#`` there."""

    def has_hash(h: Column) -> Column:
        inside = F.exists(F.slice(words, h["start"] + 1, h["n"]), lambda w: w["text"].contains("#"))
        behind = F.coalesce(F.trim(F.get(words, h["end"])["text"]) == "#", F.lit(False))
        return inside | behind

    return F.filter(
        field_phrases(labels).hits(words), lambda h: ~h["label"].contains("#") | has_hash(h)
    )


def match_labels(lines: DataFrame, labels=lx.FIELD_LABELS) -> DataFrame:
    """Add ``hits`` (label matches) to a line table."""
    return lines.withColumn("hits", label_hits(F.col("words"), labels))


def shadowed(hits: Column, h: Column) -> Column:
    """A longer label starts at the same word."""
    return F.exists(hits, lambda o: (o["start"] == h["start"]) & (o["end"] > h["end"]))


def drop_shadowed(hits: Column) -> Column:
    return F.filter(hits, lambda h: ~shadowed(hits, h))


def first_label(hits: Column, key: str) -> Column:
    """The match of a key with most tokens, then by label rank, then leftmost; or NULL."""
    ranked = F.transform(
        F.filter(hits, lambda h: h["key"] == key),
        lambda h: F.struct((-h["n"]).alias("a"), h["ord"].alias("b"), h["start"].alias("c"), h.alias("h")),
    )
    return F.array_min(ranked)["h"]


def value_boundary(words: Column, hits: Column, h: Column) -> Column:
    """Index of the next label on the line, else its length."""
    later = F.transform(F.filter(hits, lambda o: o["start"] >= h["end"]), lambda o: o["start"])
    return F.coalesce(F.array_min(later), F.size(words))


def value_words(words: Column, hits: Column, h: Column) -> Column:
    """Words between a label and the next label."""
    return spoken(F.slice(words, h["end"] + 1, value_boundary(words, hits, h) - h["end"]))


def words_after(words: Column, h: Column) -> Column:
    return spoken(F.slice(words, h["end"] + 1, F.size(words)))


def spoken(words: Column) -> Column:
    """Words that hold a letter or digit."""
    return F.filter(words, lambda w: w["tok"] != "")


def join_words(words: Column) -> Column:
    """Text of words in the order given."""
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def words_text(words: Column) -> Column:
    """Text of words top-down, left to right."""
    return F.trim(join_words(F.sort_array(words)))


# --- line tests (P28) ------------------------------------------------------------------


def is_total_line(words: Column, hits: Column) -> Column:
    return F.exists(hits, lambda h: h["key"].isin(*lx.MONEY_KEYS)) | F.exists(
        words, lambda w: w["tok"] == "total"
    )


def is_bottom_or_right(top: Column, x0: Column) -> Column:
    return (top > 360) | (x0 > 260)


def overlaps_x(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0) > 0


def total_phrases(labels=lx.FIELD_LABELS) -> Phrases:
    phrases = ["total"] + [x for k in lx.MONEY_KEYS for x in labels[k]]
    return Phrases(
        [(tx.heading_words(p), "total", p, i) for i, p in enumerate(phrases) if tx.heading_words(p)]
    )


def first_money_index(words: Column) -> Column:
    """Index of the first word that begins an amount, else the number of words."""
    def test(w: Column, i: Column) -> Column:
        nxt = F.coalesce(F.get(words, i + 1)["num"], F.lit(False)) | F.coalesce(
            F.get(words, i + 2)["num"], F.lit(False)
        )
        prev = F.get(words, F.greatest(i - 1, F.lit(0)))
        after_money = w["num"] & (i > 0) & (prev["cur"] | prev["num"])
        return F.when(w["money"] | (w["cur"] & nxt), i).when(after_money, i - 1)

    return F.coalesce(F.array_min(F.transform(words, test)), F.size(words))


# --- lines around a line (W7) ----------------------------------------------------------


def following_lines(anchors: DataFrame, lines: DataFrame, gap: float, n: int) -> DataFrame:
    """Up to ``n`` lines below each anchor whose top is within ``gap`` of its bottom.

    ``anchors`` has doc_id, page, anchor_id, bottom. One sorted pass over the page counts the
    lines that begin at or above each anchor's bottom; line numbers then name the followers,
    so they arrive by an equi-join and no pairs of lines are formed.
    """
    at = lines.select("doc_id", "page", F.col("top").alias("_y"), F.lit(0).alias("_q"), F.lit(None).cast("string").alias("anchor_id"))
    ask = anchors.select("doc_id", "page", F.col("bottom").alias("_y"), F.lit(1).alias("_q"), "anchor_id")
    order = Window.partitionBy("doc_id", "page").orderBy("_y", "_q")
    seen = F.sum(1 - F.col("_q")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    wanted = (
        at.unionByName(ask)
        .withColumn("_seen", seen)
        .filter("_q = 1")
        .select(
            "doc_id", "page", "anchor_id", F.col("_y").alias("anchor_bottom"),
            F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"), "_seen",
        )
        .withColumn("line_no", (F.col("_seen") + F.col("k")).cast("int"))
        .drop("_seen")
    )
    return wanted.join(lines, ["doc_id", "page", "line_no"]).filter(
        F.col("top") - F.col("anchor_bottom") <= gap
    )


# --- identifiers near a label (J18) ----------------------------------------------------


def leading_identifier(first: Column, second: Column) -> Column:
    """Identifier in one word, or in two when the first is a known prefix."""
    single, pair = F.array(first), F.array(first, second)

    def shape(value: Column, ws: Column) -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(
                words_text(ws).alias("raw"), value.alias("value"), box_of_words(ws).alias("bbox"),
                first["x0"].alias("x0"), first["top"].alias("top"),
            ),
        )

    two = F.when(second.isNotNull() & first["tok"].isin(*lx.IDENTIFIER_PREFIXES), tx.identifier_value(words_text(pair)))
    return F.coalesce(
        tx.let(tx.identifier_value(first["text"]), lambda v: shape(v, single)), tx.let(two, lambda v: shape(v, pair))
    )


def identifier_spans(words: Column) -> Column:
    """Every identifier that starts at some word of a line."""
    return F.filter(
        F.transform(words, lambda w, i: leading_identifier(w, F.get(words, i + 1))),
        lambda s: s.isNotNull(),
    )


def nearest_identifier(asks: DataFrame, lines: DataFrame) -> DataFrame:
    """For label rows without a value, the closest identifier on label-free lines.

    ``asks`` has doc_id, page, anchor_id, field, anchor_x, mid, top. Closest is by vertical
    then horizontal distance. A line's neighbours in vertical order are carried along one
    sorted pass in each direction, so each ask sees two candidate lines, not the whole page.
    For invoice numbers a line counts only if its closest identifier is no purchase order;
    lines that mix both kinds depend on the asker and are joined to it directly.
    """
    pages = asks.select("doc_id", "page").distinct()
    spans = (
        lines.filter(F.size("hits") == 0)
        .filter(F.col("text").rlike(r"\d"))
        .join(pages, ["doc_id", "page"], "left_semi")
        .select(
            "doc_id", "page", "line_no", ((F.col("top") + F.col("bottom")) / 2).alias("mid"),
            identifier_spans(F.col("words")).alias("spans"),
        )
        .filter(F.size("spans") > 0)
    )
    is_po = lambda s: s["value"].rlike(r"(?i)^PO[-#/:]")
    spans = spans.withColumn("po", F.exists("spans", is_po)).withColumn(
        "other", F.exists("spans", lambda s: ~is_po(s))
    )
    entry = F.struct("line_no", "mid", "spans")
    rows = spans.groupBy("doc_id", "page", "mid").agg(
        F.collect_list(entry).alias("any_line"),
        F.collect_list(F.when(~F.col("po"), entry)).alias("pure"),
    )
    kinds = {"any_line": "purchase_order", "pure": "invoice_number"}
    marks = rows.select(
        "doc_id", "page", "mid", F.lit(0).alias("_q"), "any_line",
        F.when(F.size("pure") > 0, F.col("pure")).alias("pure"),
    ).unionByName(
        asks.select("doc_id", "page", "mid", F.lit(1).alias("_q"), "anchor_id", "field", "anchor_x", "top"),
        allowMissingColumns=True,
    )
    down = Window.partitionBy("doc_id", "page").orderBy("mid", "_q").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("doc_id", "page").orderBy(F.desc("mid"), "_q").rowsBetween(Window.unboundedPreceding, 0)
    for name in kinds:
        for way, w in (("above", down), ("below", up)):
            marks = marks.withColumn(f"{name}_{way}", F.last(name, ignorenulls=True).over(w))
    near = marks.filter("_q = 1").withColumn(
        "seen",
        F.when(
            F.col("field") == "invoice_number",
            F.array("pure_above", "pure_below"),
        ).otherwise(F.array("any_line_above", "any_line_below")),
    )
    ask_cols = ["doc_id", "page", "anchor_id", "field", "anchor_x", "mid", "top"]
    direct = near.select(*ask_cols, F.explode("seen").alias("_g")).select(*ask_cols, F.explode("_g").alias("line"))
    mixed = spans.filter("po and other").select(
        "doc_id", "page", F.struct("line_no", "mid", "spans").alias("line")
    )
    depends = asks.filter(F.col("field") == "invoice_number").select(*ask_cols).join(mixed, ["doc_id", "page"])
    best_span = F.array_min(
        F.transform(
            F.col("line.spans"),
            lambda s, i: F.struct(F.abs(s["x0"] - F.col("anchor_x")).alias("d"), i.alias("i"), s.alias("s")),
        )
    )
    scored = (
        direct.unionByName(depends)
        .withColumn("_b", best_span)
        .filter((F.col("field") != "invoice_number") | ~is_po(F.col("_b.s")))
        .select(
            "anchor_id", "top",
            F.struct(
                F.abs(F.col("line.mid") - F.col("mid")).alias("v"), F.col("_b.d").alias("h"),
                F.col("line.line_no").alias("n"), F.col("_b.s").alias("s"),
            ).alias("_r"),
        )
    )
    return scored.groupBy("anchor_id").agg(F.min("_r").alias("_r"), F.first("top").alias("_t")).select(
        "anchor_id",
        F.col("_r.s.raw").alias("raw"),
        F.col("_r.s.value").alias("value"),
        F.col("_r.s.bbox").alias("bbox"),
        F.when(F.col("_r.s.top") < F.col("_t"), "nearby_above").otherwise("nearby_below").alias("method"),
    )


# --- second-source calibration (J17) and mentions (P22) --------------------------------


#: Side of a cell of a page in points, and the last cell of a row or column: what lies beyond is in it.
CELL, LAST_CELL = 36.0, 63


def _cell(at: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(LAST_CELL), F.floor(at / CELL))).cast("int")


def words_by_cell(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Words (middle ``_x``, ``_y``, confidence ``_c``) with the boxes that reach into their cell of the page.

    A word lies in one cell, a box in all that it covers, so the two meet by equality and a page's
    words don't meet all its boxes.
    """
    edge = lambda i: F.get("bbox", F.lit(i))
    cells = lambda lo, hi: F.when(lo <= hi, F.sequence(_cell(lo), _cell(hi)))
    boxes = fields.select("doc_id", "field", "page", "bbox", F.explode(cells(edge(0), edge(2))).alias("_cx")).withColumn("_cy", F.explode(cells(edge(1), edge(3))))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    middles = words.filter("confidence is not null").select("doc_id", "page", F.col("confidence").alias("_c"), x.alias("_x"), y.alias("_y"), _cell(x).alias("_cx"), _cell(y).alias("_cy"))
    return boxes.join(middles, ["doc_id", "page", "_cx", "_cy"])


def calibrate_confidence(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Cap a field's confidence by the 20th percentile of the words inside its box.

    Words meet the boxes of their own cell of a page only; the rank inside a box replaces a sorted list.
    """
    inside = words_by_cell(fields, words).filter("_x between bbox[0] and bbox[2] and _y between bbox[1] and bbox[3]")
    w = Window.partitionBy("doc_id", "field")
    picked = (
        inside.withColumn("_r", F.row_number().over(w.orderBy("_c")))
        .withColumn("_n", F.count("*").over(w))
        .filter(F.col("_r") == F.bround((F.col("_n") - 1) * 0.2, 0) + 1)
        .select("doc_id", "field", F.round("_c", 3).alias("word_confidence"))
    )
    return fields.join(picked, ["doc_id", "field"], "left").withColumn(
        "confidence", F.round(F.least("confidence", F.coalesce("word_confidence", "confidence")), 3)
    )


def mentions(text: Column, key: str, labels=lx.FIELD_LABELS) -> Column:
    """A page's text contains any label of a field."""
    return mentions_lower(lower_text(text), key, labels)


def lower_text(text: Column) -> Column:
    return F.lower(tx.text_or_empty(text))


def mentions_lower(low: Column, key: str, labels=lx.FIELD_LABELS) -> Column:
    """As :func:`mentions`, of a text in lower case: made once, it serves all fields."""
    phrases = lx.LINE_ITEM_MENTIONS if key == "line_items" else labels.get(key, (key.replace("_", " "),))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p.lower())
    return out


def mentioned_fields(text: Column, keys=(*lx.FIELD_KEYS, "line_items"), labels=lx.FIELD_LABELS) -> Column:
    return mentioned_lower(lower_text(text), keys, labels)


def mentioned_lower(low: Column, keys=(*lx.FIELD_KEYS, "line_items"), labels=lx.FIELD_LABELS) -> Column:
    """As :func:`mentioned_fields`, of a text in lower case."""
    return F.array_compact(F.array(*[F.when(mentions_lower(low, k, labels), F.lit(k)) for k in keys]))


def pages_mention(pages: DataFrame, keys=(*lx.FIELD_KEYS, "line_items")) -> DataFrame:
    """One row per (doc_id, field) that any page of the document mentions.

    Staged twice: the lower-case text would be made again for every phrase, and the filter that
    Spark infers from exploding a column would search every phrase again.
    """
    low = stage(pages.select("doc_id", "text"), text=lower_text(F.col("text")))
    found = stage(low, text=mentioned_lower(F.col("text"), keys))
    return found.select("doc_id", F.explode("text").alias("field")).distinct()
