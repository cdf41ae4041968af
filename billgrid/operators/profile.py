"""Page profiles and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billgrid.functions import lexicon as lx
from billgrid.functions import text as tx
from billgrid.operators.candidates import stage
from billgrid.operators.grid import lower_text, mentions_lower


def profile_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """A5: per page word counts, printable and duplicate ratios, route and reasons.

    Duplicates are words with equal text at equal rounded places. They are pre-counted per
    place, so every step is a mergeable aggregate.
    """
    t = tx.strip_ws(F.col("text"))
    place = ["doc_id", "page", F.lower("text").alias("t"), *[F.bround(c, 0).alias(c) for c in ("x0", "top", "x1", "bottom")]]
    # a page's words meet once: what follows stays in their partition
    at_page = words.select("doc_id", "page", "text", "x0", "top", "x1", "bottom").repartition("doc_id", "page")
    per_place = at_page.groupBy(*place).agg(
        F.count("*").alias("n"),
        F.count_if(t != "").alias("filled"),
        F.sum(F.length(t)).alias("visible"),
        F.sum(F.length(F.regexp_replace(t, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}]", ""))).alias("printable"),
    )
    facts = per_place.groupBy("doc_id", "page").agg(
        F.sum("filled").alias("word_count"), F.sum("visible").alias("visible_char_count"),
        F.sum("printable").alias("_printable"), F.sum("n").alias("_words"), (F.sum("n") - F.count("*")).alias("_dups"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    p = pages.join(facts, ["doc_id", "page"], "left").select(
        "doc_id", "page", *[zero(c).alias(c) for c in ("word_count", "visible_char_count")],
        F.when(zero("visible_char_count") > 0, F.col("_printable") / F.col("visible_char_count")).otherwise(0.0).alias("_pr"),
        F.when(zero("_words") > 0, F.col("_dups") / F.col("_words")).otherwise(0.0).alias("_dr"),
        F.coalesce("char_count", zero("visible_char_count")).alias("_chars"),
    )
    unusable = no_text_layer(F.col("_chars"), F.col("visible_char_count"), F.col("word_count"))
    reasons = F.when(unusable, F.array(F.lit("no_usable_native_text"))).otherwise(F.array_compact(F.array(
        F.when(F.col("word_count") < 20, F.lit("sparse_native_text")),
        F.when(F.col("_pr") < 0.90, F.lit("garbled_native_text")),
        F.when(F.col("_dr") > 0.15, F.lit("duplicate_native_words")),
    )))
    return p.select(
        "doc_id", "page",
        F.when(unusable, "local_ocr").when(F.size(reasons) > 0, "hybrid").otherwise("native_text").alias("route"),
        "word_count", "visible_char_count", F.bround("_pr", 3).alias("printable_ratio"),
        F.bround("_dr", 3).alias("duplicate_word_ratio"), reasons.alias("reasons"),
    )


def no_text_layer(char_count: Column, visible: Column, words: Column) -> Column:
    """Too little text to read anything from."""
    return (char_count == 0) | (visible < 8) | (words < 3)


def document_text_layer(words: DataFrame) -> DataFrame:
    """A7 per document: whether its words amount to a usable text layer."""
    t = tx.strip_ws(F.col("text"))
    return words.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.sum(F.length(t)).alias("visible"), F.sum(F.length("text")).alias("chars")
    ).select("doc_id", "words", "visible", no_text_layer(F.col("chars"), F.col("visible"), F.col("words")).alias("no_text_layer"))


def document_route(profiles: DataFrame, second_used: DataFrame | None = None) -> DataFrame:
    """One route per document from its pages' routes."""
    routes = profiles.groupBy("doc_id").agg(F.sort_array(F.collect_set("route")).alias("routes"))
    if second_used is None:
        routes = routes.withColumn("ocr_used", F.lit(False))
    else:
        routes = routes.join(second_used.select("doc_id", "ocr_used"), "doc_id", "left").fillna({"ocr_used": False})
    return routes.withColumn(
        "route",
        F.when(~F.col("ocr_used") & (F.size(F.array_except("routes", F.array(F.lit("native_text")))) == 0), "native_text")
        .when(F.col("routes") == F.array(F.lit("local_ocr")), "local_ocr")
        .otherwise("hybrid"),
    )


def restrict_pages(words: DataFrame, pages: DataFrame, document_confidence: DataFrame) -> DataFrame:
    """Mean word confidence over chosen pages, else the document's own value."""
    kept = words.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    means = kept.groupBy("doc_id").agg(F.count("*").alias("word_count"), F.avg("confidence").alias("_mean"))
    return document_confidence.join(means, "doc_id", "left").select(
        "doc_id", F.coalesce("word_count", F.lit(0)).alias("word_count"), F.round(F.coalesce("_mean", "confidence"), 3).alias("confidence")
    )


def important_pages(pages: DataFrame, targets: DataFrame, n: int | None = None) -> DataFrame:
    """Pages naming a target field, then the first, the last, the rest; ``n`` at most.

    ``targets``: doc_id, targets array. Ranking needs only page numbers, not page texts.
    """
    named = F.lit(False)
    for key in (*lx.FIELD_KEYS, "line_items"):
        named = named | (F.array_contains("targets", key) & mentions_lower(F.col("_low"), key))
    ends = pages.groupBy("doc_id").agg(F.min("page").alias("_first"), F.max("page").alias("_last"))
    cls = F.when(F.col("_named"), 0).when(F.col("page") == F.col("_first"), 1).when(F.col("page") == F.col("_last"), 2).otherwise(3)
    ranked = (
        stage(pages.select("doc_id", "page", "text"), _low=lower_text(F.col("text"))).join(targets, "doc_id").withColumn("_named", named).select("doc_id", "page", "_named")
        .join(ends, "doc_id")
        .withColumn("priority", cls)
        .withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "page")))
        .select("doc_id", "page", "priority", "position")
    )
    return ranked if n is None else ranked.filter(F.col("position") <= max(0, n))


def likely_region(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Where a missing field probably stands.

    Totals and payment details are sought on the last page that hints at them, everything else
    on the first; without a hint the last or first page serves. The area is a fixed share of
    the page. ``targets``: doc_id, field. ``pages``: doc_id, page, width, height, text.
    """
    low = F.lower(tx.text_or_empty(F.col("text")))
    known = pages.filter("width > 0 and height > 0")
    hints = []
    for key in (*lx.FIELD_KEYS, "line_items"):
        hit = F.lit(False)
        for h in lx.REGION_HINTS.get(key, (key.replace("_", " "),)):
            hit = hit | low.contains(h)
        hints.append(F.when(hit, F.lit(key)))
    hinted = known.select("doc_id", "page", F.explode(F.array_compact(F.array(*hints))).alias("field")).groupBy("doc_id", "field").agg(
        F.min("page").alias("h_first"), F.max("page").alias("h_last")
    )
    ends = known.groupBy("doc_id").agg(F.min("page").alias("p_first"), F.max("page").alias("p_last"))
    bottom = F.col("field").isin(*lx.BOTTOM_FIELDS)
    page = F.when(bottom, F.coalesce("h_last", "p_last")).otherwise(F.coalesce("h_first", "p_first"))
    w, h = F.col("width"), F.col("height")
    zero = F.lit(0.0)
    area = (
        F.when(bottom, F.array(w * 0.3, h * 0.4, w, h))
        .when(F.col("field").isin("seller", "buyer"), F.array(zero, zero, w, h * 0.6))
        .when(F.col("field") == "line_items", F.array(zero, h * 0.12, w, h * 0.82))
        .otherwise(F.array(zero, zero, w, h * 0.42))
    )
    return (
        targets.select("doc_id", "field").join(ends, "doc_id").join(hinted, ["doc_id", "field"], "left")
        .withColumn("page", page)
        .join(known.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
        .select("doc_id", "field", "page", area.alias("bbox"), "width", "height")
    )


def document_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """page texts with banners. One row per page so that long documents stay spread out;
    joined in page order with blank lines they form the document text."""
    text = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    return pages.filter(tx.strip_ws(tx.text_or_empty(F.col("text"))) != "").select("doc_id", "page", text.alias("text"))
