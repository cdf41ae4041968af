"""Truth tables from manifest documents.

Documents come as rows with the document in ``d``; child tables are exploded, never collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billgrid.functions import lexicon as lx
from billgrid.functions.dates import date_or_null
from billgrid.session import materialize

NONE = "cast(array() as array<string>)"


def _doc(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.col("d.document_id").alias("document_id"), *cols)


def money_parts(m: Column) -> Column:
    """value, printed value and display text of an amount."""
    return F.struct(
        m["value"].try_cast("decimal(12,2)").alias("value"), m["visible_value"].alias("visible_value"), m["display"].alias("display_value")
    )


def truth_rows(docs: DataFrame) -> DataFrame:
    """R1."""
    amount = lambda k: F.try_element_at("d.amounts", F.lit(k))["value"].try_cast("decimal(12,2)").alias(k)
    return _doc(
        docs, "pdf_filename", "pdf_page_count", F.col("origin").alias("manifest_filename"), F.col("schema_version").alias("manifest_schema_version"),
        "suite", "fixture_slug", "d.invoice_number",
        F.coalesce("d.seller.name", F.lit("")).alias("vendor_name"), F.col("d.seller.line1").alias("vendor_line1"),
        F.col("d.seller.city").alias("vendor_city"), F.col("d.seller.email").alias("vendor_email"), F.col("d.seller.tax_id").alias("vendor_tax_id"),
        F.coalesce("d.buyer.name", F.lit("")).alias("customer_name"), F.col("d.buyer.line1").alias("customer_line1"), F.col("d.buyer.city").alias("customer_city"),
        date_or_null(F.col("d.issue_date.value")).alias("issue_date"), F.col("d.issue_date.display").alias("issue_date_display"),
        date_or_null(F.col("d.due_date.value")).alias("due_date"), F.col("d.due_date.display").alias("due_date_display"),
        "d.purchase_order", "d.terms", "d.status", "d.currency", *[amount(k) for k in lx.TRUTH_MONEY_KEYS],
    )


def truth_labels(docs: DataFrame) -> DataFrame:
    """R2."""
    return _doc(docs, F.explode("d.labels").alias("label_key", "label_text")).filter("label_text is not null")


def truth_amounts(docs: DataFrame) -> DataFrame:
    """The seven amounts that are present."""
    rows = F.array(*[F.struct(F.lit(k).alias("amount_key"), money_parts(F.try_element_at("d.amounts", F.lit(k))).alias("m")) for k in lx.TRUTH_MONEY_KEYS])
    return _doc(docs, F.explode(rows).alias("r")).select(
        "document_id", "r.amount_key", F.col("r.m.value").alias("amount_value"), F.col("r.m.visible_value").alias("visible_value"),
        F.col("r.m.display_value").alias("display_value"),
    ).filter("amount_value is not null")


def truth_line_items(docs: DataFrame) -> DataFrame:
    """Items counted from 1."""
    rows = _doc(docs, F.posexplode("d.line_items").alias("pos", "i")).filter("i is not null")
    u, a = money_parts(F.col("i.unit_price")), money_parts(F.col("i.amount"))
    return rows.select(
        "document_id", (F.col("pos") + 1).alias("line_item_index"), F.col("i.line").alias("line_number"), "i.sku", "i.hsn", F.col("i.name").alias("item_name"),
        "i.description", F.col("i.quantity").try_cast("decimal(12,4)").alias("quantity"), "i.quantity_display",
        u["value"].alias("unit_price_value"), u["visible_value"].alias("unit_price_visible_value"), u["display_value"].alias("unit_price_display"),
        a["value"].alias("amount_value"), a["visible_value"].alias("amount_visible_value"), a["display_value"].alias("amount_display"),
        date_or_null(F.col("i.service_date.value")).alias("service_date"), F.col("i.service_date.display").alias("service_date_display"),
    )


def truth_tables(docs: DataFrame) -> DataFrame:
    """R5."""
    no = F.lit(False)
    return _doc(
        docs.filter("d.table is not null"), F.col("d.table.variant").alias("variant"), F.coalesce("d.table.show_description", no).alias("show_description"),
        F.col("d.table.total_placement").alias("total_placement"), F.coalesce("d.table.continued_across_pages", no).alias("continued_across_pages"),
    )


def truth_table_columns(docs: DataFrame) -> DataFrame:
    """R6."""
    return _doc(docs, F.posexplode("d.table.columns").alias("pos", "c")).filter("c is not null").select(
        "document_id", (F.col("pos") + 1).alias("column_index"), F.col("c.key").alias("column_key"), F.col("c.label").alias("column_label"),
        F.coalesce("c.numeric", F.lit(False)).alias("is_numeric"),
    )


def truth_sample_ids(docs: DataFrame) -> DataFrame:
    """R7."""
    return _doc(docs, F.posexplode("d.sample_ids").alias("pos", "sample_id")).select("document_id", (F.col("pos") + 1).alias("sample_index"), "sample_id")


def truth_tags(docs: DataFrame) -> DataFrame:
    """Distinct tags."""
    return _doc(docs, F.explode(F.array_sort(F.array_distinct("d.challenge_tags"))).alias("challenge_tag"))


def _pages(docs: DataFrame) -> DataFrame:
    return _doc(docs, F.posexplode("d.pages").alias("pos", "p")).filter("p is not null").withColumn(
        "pdf_page_number", F.coalesce(F.nullif(F.col("p.pdf_page_number"), F.lit(0)), F.col("pos") + 1)
    )


def truth_pages(docs: DataFrame) -> DataFrame:
    """R9."""
    flag = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(False)).alias(c)
    return _pages(docs).select(
        "document_id", "pdf_page_number", "p.document_page_number", "p.document_page_count", "p.sample_id",
        flag("table_continues_from_previous_page"), flag("table_continues_after_page"), flag("renders_totals"), "p.total_placement", flag("notes_near_table_bounds"),
    )


def truth_page_items(docs: DataFrame) -> DataFrame:
    """R10."""
    return _pages(docs).select("document_id", "pdf_page_number", F.posexplode("p.line_item_numbers").alias("i", "line_number")).filter("line_number is not null").select(
        "document_id", "pdf_page_number", (F.col("i") + 1).alias("line_item_index"), "line_number"
    )


def truth_components(docs: DataFrame) -> DataFrame:
    """Component boxes, short ones padded with NULL."""
    rows = _pages(docs).select("document_id", "pdf_page_number", F.posexplode("p.components").alias("i", "c"))
    edge = lambda i, n: F.get("c.bbox_mm", F.lit(i)).try_cast("decimal(10,2)").alias(n)
    return rows.select(
        "document_id", "pdf_page_number", (F.col("i") + 1).alias("component_index"), F.coalesce("c.kind", F.lit("")).alias("component_kind"),
        edge(0, "bbox_x_mm"), edge(1, "bbox_y_mm"), edge(2, "bbox_width_mm"), edge(3, "bbox_height_mm"),
    )


STAR = {
    "truth": truth_rows, "labels": truth_labels, "amounts": truth_amounts, "line_items": truth_line_items, "tables": truth_tables,
    "table_columns": truth_table_columns, "sample_ids": truth_sample_ids, "tags": truth_tags, "pages": truth_pages,
    "page_items": truth_page_items, "components": truth_components,
}


def _star_folder(spark: SparkSession, *parts: str):
    """A folder of a stored star and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _star_versions(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, version, number: the last version of each batch that was named as a whole."""
    last = spark.read.schema("batch_id string, version string, number long").parquet(f"{path}/versions")
    return last.groupBy("batch_id").agg(F.max(F.struct("number", "version")).alias("v")).select("batch_id", "v.version", "v.number")


def write_truth_star(docs: DataFrame, path: str, batch_id: str, stored: bool = False) -> None:
    """Every table of the star, this batch replaced as a whole.

    Each table gets a new version of the batch, in columns of its own and without a shuffle; a table without
    rows gets one that is empty. Readers go by the versions named in one small table, which names the
    new one when all tables are written: until then the star is as it was. Other versions of the batch, also
    of writers that failed, are removed afterwards. The documents are read once for each table: they are
    stored first, unless they are read from a table anyway (``stored``).
    """
    spark, batch = docs.sparkSession, f"batch=b{batch_id.encode().hex()}"
    docs = docs if stored else materialize(docs, "manifest-documents")
    version = f"v{uuid.uuid4().hex}"
    for name, build in STAR.items():
        build(docs).write.mode("errorifexists").parquet(f"{path}/{name}/{batch}/version={version}")
    folder, fs = _star_folder(spark, path, "versions")
    number = (_star_versions(spark, path).agg(F.max("number")).first()[0] or 0) + 1 if fs.exists(folder) else 1
    spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(version).alias("version"), F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    for name in STAR:
        folder, fs = _star_folder(spark, path, name, batch)
        for old in fs.listStatus(folder):
            if old.getPath().getName() != f"version={version}":
                fs.delete(old.getPath(), True)


def read_truth_star(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the stored star, with the batch of each row."""
    # one row for each batch
    return spark.read.parquet(f"{path}/{table}").drop("batch").join(F.broadcast(_star_versions(spark, path).select("version", "batch_id")), "version").drop("version")


def truth_summary(truth: DataFrame, items: DataFrame) -> DataFrame:
    """A2: headers with their item count."""
    counts = items.groupBy("document_id").agg(F.count("*").alias("line_item_count"))
    return truth.join(counts, "document_id", "left").withColumn("line_item_count", F.coalesce("line_item_count", F.lit(0)))


# --- assembling documents from pages ---------------------------------------------------


def assemble_documents(pages: DataFrame) -> DataFrame:
    """Document headers from page rows (document_id, pdf_page_number, page_index, ...).

    Pages stay rows; a header only carries mergeable facts, and the first page (and first
    procurement context) by page order.
    """
    order = F.struct(F.coalesce("page_index", "pdf_page_number").alias("o"), "pdf_page_number")
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"), F.min_by("sample_id", order).alias("first_sample"),
        F.min_by("ap_context", F.when(F.col("ap_context").isNotNull(), order)).alias("ap_context"),
        F.bool_or(F.coalesce("continues", F.lit(False))).alias("continues"),
    ).withColumn("continued_across_pages", F.col("page_count") > 1)


def combine_line_items(items: DataFrame) -> DataFrame:
    """The last page's version of each line number."""
    value = F.struct(*[c for c in items.columns if c not in ("document_id", "line")])
    return items.groupBy("document_id", "line").agg(F.max_by(value, F.struct("page", "pos")).alias("v")).select("document_id", "line", "v.*")


def page_placement(in_table: Column, side_panel: Column) -> Column:
    return F.when(in_table & side_panel, "mixed").when(in_table, "table_row").when(side_panel, "side_panel").otherwise("none")


def total_placement(pages: DataFrame) -> DataFrame:
    """Where a document's totals stand."""
    seen = F.when(F.col("placement") != "none", F.col("placement"))
    return pages.groupBy("document_id").agg(
        F.when(F.min(seen).isNull(), "none").when(F.min(seen) != F.max(seen), "mixed").otherwise(F.min(seen)).alias("total_placement")
    )


AMBIGUOUS_PARTY_WORDS = ("Account", "To", "Source", "Entity")
GLYPH_CURRENCIES = ("INR", "EUR", "CNY", "JPY", "MXN", "AUD", "CAD", "SGD")


def challenge_tags(docs: DataFrame) -> DataFrame:
    """Tags a document earns. Columns: page_count, continues, notes_near, placement,
    labels map, currency, money_style, own_tags, edge_tags."""
    word = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)).isin(*AMBIGUOUS_PARTY_WORDS), F.lit(False))
    earned = F.array_compact(F.array(
        F.when(F.col("page_count") > 1, F.lit("multi_page_invoice")),
        F.when(F.col("continues"), F.lit("table_continuation_across_pages")),
        F.when(F.col("notes_near"), F.lit("notes_near_table_bounds")),
        F.when(F.col("placement") == "table_row", F.lit("totals_in_table_row")).when(F.col("placement") == "side_panel", F.lit("totals_in_side_panel"))
        .when(F.col("placement") == "mixed", F.lit("mixed_total_positions")),
        F.when(word("seller") | word("buyer") | word("document_title"), F.lit("ambiguous_entity_labels")),
        F.when(F.col("currency").isin(*GLYPH_CURRENCIES), F.lit("messy_currency_glyphs")),
        F.when(F.coalesce(F.col("money_style").contains("comma"), F.lit(False)), F.lit("localized_decimal_separator")),
    ))
    none = F.expr(NONE)
    return docs.select("document_id", F.array_sort(F.array_distinct(F.concat(F.coalesce("own_tags", none), F.coalesce("edge_tags", none), earned))).alias("challenge_tags"))


def file_tags(tags: DataFrame) -> DataFrame:
    """Distinct tags per file, one row each."""
    return tags.select("origin", F.explode("challenge_tags").alias("challenge_tag")).distinct()


def notes_near_table(components: Column) -> Column:
    """Terms, footer or remittance begins within 8 mm below the first items table."""
    table = F.get(F.filter(components, lambda c: c["kind"] == "items-table"), 0)
    bottom = table["bbox_mm"][1] + table["bbox_mm"][3]
    near = F.exists(
        components, lambda c: c["kind"].isin("terms", "footer", "remittance") & (c["bbox_mm"][1] - bottom).between(0, 8)
    )
    return F.coalesce(near, F.lit(False))


def distinct_edge_cases(cases: DataFrame) -> DataFrame:
    """Cases (document_id, page, pos, case json) equal as JSON kept once, first wins."""
    stable = F.to_json(F.try_parse_json("case"))
    return cases.withColumn("case_key", stable).groupBy("document_id", "case_key").agg(
        F.min(F.struct("page", "pos", "case")).alias("f")
    ).select("document_id", "f.page", "f.pos", "f.case")


def infer_metadata(docs: DataFrame, templates: DataFrame, papers: DataFrame) -> DataFrame:
    """Template and paper of the first id that begins with ``template-paper-seed-variation``.

    ``docs``: document_id, sample_ids. Prefixes are matched by equality on every dash-cut of
    the id, so the join is an equi-join on the prefix.
    """
    prefixes = templates.select(F.col("slug").alias("template_slug")).join(
        papers.select(F.col("slug").alias("paper_slug")), F.lit(True)
    ).select("template_slug", "paper_slug", F.concat_ws("-", "template_slug", "paper_slug").alias("prefix"))
    ids = docs.select("document_id", F.posexplode(F.concat(F.array("document_id"), F.coalesce("sample_ids", F.expr(NONE)))).alias("n", "sid"))
    parts = F.split("sid", "-")
    cuts = ids.select("document_id", "n", "sid", F.explode(F.sequence(F.lit(2), F.greatest(F.size(parts) - 2, F.lit(2)))).alias("k")).select(
        "document_id", "n", "sid", "k", F.array_join(F.slice(F.split("sid", "-"), F.lit(1), F.col("k")), "-").alias("prefix"),
        F.get(F.split("sid", "-"), F.col("k")).try_cast("int").alias("sample_seed"),
        F.get(F.split("sid", "-"), F.col("k") + 1).try_cast("int").alias("variation_index"),
    ).filter("sample_seed is not null and variation_index is not null")
    rank = F.struct("n", (-F.length("template_slug")).alias("t"), (-F.length("paper_slug")).alias("p"))
    best = cuts.join(prefixes, "prefix").groupBy("document_id").agg(
        F.min_by(F.struct("template_slug", "paper_slug", "sample_seed", "variation_index"), rank).alias("m")
    ).select("document_id", "m.*")
    return docs.select("document_id").join(best, "document_id", "left").fillna({"template_slug": "unknown", "paper_slug": "unknown"})


#: A task meets about this many of the documents that name one sample id.
NAMED_TOGETHER = 100_000


def first_sample(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """The first of a document's sample ids that exists.

    An id that very many documents name is met in several parts, by document; ids of that kind are
    as few as all ids divided by NAMED_TOGETHER.
    """
    ids = materialize(docs.select("document_id", F.posexplode("sample_ids").alias("pos", "sample_id")), "named-samples")
    often = ids.groupBy("sample_id").count().filter(F.col("count") > NAMED_TOGETHER)
    often = F.broadcast(materialize(often.select("sample_id", F.ceil(F.col("count") / NAMED_TOGETHER).cast("int").alias("_parts")), "frequent-samples"))
    value = F.struct("sample_id", *[c for c in samples.columns if c != "sample_id"])
    ids = ids.join(often, "sample_id", "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.hash("document_id"), "_parts")).otherwise(0)).drop("_parts")
    last = F.coalesce("_parts", F.lit(1)) - 1
    samples = samples.join(often, "sample_id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("_parts")
    return ids.join(samples, ["sample_id", "_part"]).groupBy("document_id").agg(F.min_by(value, "pos").alias("s")).select("document_id", "s.*")
