"""Steps that grew faster than their input: results and the shape of their plans."""

from pyspark.sql import functions as F

from billgrid import session
from billgrid.functions import text
from billgrid.operators import decide, grid, match, merge, profile, truth, validate
from billgrid.plans import catalog
from billgrid.plans import fixtures as fx


def _invoices(spark):
    return spark.sql("""
        SELECT id AS k, cast(id AS string) AS doc_id, 'US' AS owner, 'INV-' || id AS invoice_number, 'PO-' || id AS purchase_order,
          'Acme#1 Inc' AS vendor, ' Buyer Ltd ' AS buyer, id AS suppkey, date'2026-01-02' AS issue_date, date'2026-02-01' AS due_date,
          cast(10 AS decimal(12,2)) AS subtotal, cast(0 AS decimal(12,2)) AS discount, cast(1 AS decimal(12,2)) AS tax,
          cast(11 AS decimal(12,2)) AS balance_due, 'USD' AS currency, 1L AS n_lines, 'O' AS order_status, '**** 0001' AS bank_account
        FROM range(1, 4)""")


def test_contexts_are_not_broadcast(spark):
    inv = _invoices(spark)
    ap = fx.ap_records(inv)
    matches = spark.sql("SELECT cast(id AS string) AS doc_id, id AS ap_id, 1.0D AS similarity, 'vendor_po' AS match_strategy FROM range(1, 3)")
    out = match.hydrate_context(fx.normalized(inv), matches, ap)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.context_available for r in out.collect()} == {"1": True, "2": True, "3": False}


def test_only_offers_of_asked_keys_are_counted(spark):
    questions = spark.createDataFrame([("US", 1, "a", "a", "acme")], "owner string, tier int, key string, q string, vendor string")
    offers = spark.createDataFrame([("US", 1, "a", "acme co"), ("US", 1, "b", "other")], "owner string, tier int, key string, ap_vendor string")
    counted = []
    keep = match.spectrum
    try:
        match.spectrum = lambda c: F.udf(lambda v: (_ for _ in ()).throw(ValueError(v)) if v == "other" else [1] * 32, "array<int>")(c)
        counted = match.contenders(questions, offers).collect()
    finally:
        match.spectrum = keep
    assert [r.ap_vendor for r in counted] == ["acme co"]


DOC = "doc_id string, source long, number string, po string, vendor string, amount decimal(12,2), wanted string"


def test_lesser_agreements_are_asked_where_the_whole_is_not_found(spark, monkeypatch):
    invoices = spark.createDataFrame([
        ("whole", 1, "1", "p1", "v", None, None), ("part", 1, "2", "p9", "v", None, None), ("none", 1, "8", "p8", "w", None, None),
        # rows of one id: the best of both stands, although the smaller one is found whole
        ("twice", 2, "", "", "v", None, None), ("twice", 2, "5", "p5", "x", None, None),
        (None, 1, "1", "p1", "v", None, None),
    ], DOC)
    docs = spark.createDataFrame([
        ("d1", 1, "1", "p1", "v", None, None), ("d2", 1, "2", "p2", "v", None, None),
        ("d3", 2, "9", "p9", "v", None, None), ("d4", 2, "5", "p5", "y", None, None),
    ], DOC).withColumnRenamed("doc_id", "document_id").withColumn("position", F.substring("document_id", 2, 1).cast("long")).drop("wanted")
    met = []
    ask = match._best_agreement
    monkeypatch.setattr(match, "_best_agreement", lambda a, o: met.append(a.filter("doc_id = 'whole'").count()) or ask(a, o))
    got = {(r.doc_id, r.document_id, r.score) for r in match.select_document(invoices, docs).filter("doc_id is not null").collect()}
    assert got == {("whole", "d1", 9), ("part", "d2", 6), ("none", "d1", 0), ("twice", "d4", 7)}
    assert met == [1, 0]
    assert match.select_document(invoices, docs).filter("doc_id is null and score > 0").count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_texts_are_lowered_once(spark):
    pages = spark.createDataFrame([("a", "TAX 5"), ("a", "Tax"), ("b", None), ("c", "Due Date")], "doc_id string, text string")
    out = grid.pages_mention(pages, ("tax", "due_date"))
    assert _plan(out).count("lower(") == 1
    assert {tuple(r) for r in out.collect()} == {("a", "tax"), ("c", "due_date")}


def test_places_on_the_grid_follow_from_the_line(spark):
    docs = spark.createDataFrame([("a", "ab  \U0001f600d ef\n\nx"), ("b", None), ("c", "one two"), ("c", "one two")], "doc_id string, text string")
    got = sorted((r.doc_id, r.top / 12, r.text, r.x0 / 6) for r in fx.words_on_grid(docs).collect())
    assert got[:4] == [("a", 0, "ab", 0), ("a", 0, "ef", 7), ("a", 0, "\U0001f600d", 4), ("a", 2, "x", 0)]
    # documents of one id run on into each other
    assert got[4:] == [("c", 0, "one", 0), ("c", 0, "one", 4), ("c", 0, "two", 8), ("c", 0, "two", 12)]


WORD = "doc_id string, page int, text string, x0 double, top double, x1 double, bottom double, confidence double"


def test_words_meet_by_page_not_by_place(spark):
    words = spark.createDataFrame([("a", 1, t, 0.0, 0.0, 9.0, 8.0, None) for t in ("Ab", "aB", "c")], WORD)
    pages = spark.createDataFrame([("a", 1, 612.0, 792.0, 5)], "doc_id string, page int, width double, height double, char_count long")
    out = profile.profile_pages(words, pages)
    assert not [x for x in _plan(out).split("Exchange hashpartitioning(")[1:] if "x0" in x.split("\n")[0]]
    assert [(r.word_count, r.duplicate_word_ratio) for r in out.collect()] == [(3, 0.333)]


def test_facts_of_words_nobody_reads_are_not_made(spark):
    words = spark.createDataFrame([("a", 1, "USD", 0.0, 0.0, 9.0, 8.0, None), ("a", 1, "5.00", 10.0, 0.0, 19.0, 8.0, None)], WORD)
    lines = grid.build_lines(words)
    assert "regexp_replace" not in _plan(lines.groupBy("doc_id").count())
    assert [[(w.text, w.tok, w.htok, w.money, w.cur, w.num) for w in r.words] for r in lines.collect()] == [
        [("USD", "usd", "usd", False, True, False), ("5.00", "500", "500", True, False, True)]]


def test_increments_are_read_once(spark):
    raws = ["USD 12", "12.5", "(12,50)", "1.25 \n", " 3.5 ", "1.234", "", None, "5.25\nx"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", text.display_increment(F.col("raw")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [1.0, 0.1, 0.01, 0.01, 0.1, 1.0, 1.0, 1.0, 1.0]
    out = fx.parsed(_invoices(spark)).select(validate.check_amount_composition()["status"].alias("s"))
    # the status stands three times in a check, each with one lambda for all amounts
    assert _plan(out).split("\n\n")[0].count("regexp_extract") == 3
    assert {r.s for r in out.collect()} == {"pass"}


def test_a_field_is_parsed_once(spark):
    assert merge._bad_value(F.col("j"), True)._jc.toString().count("get_json_object") == 2
    good = '{"value":1.5,"confidence":0.9}'
    rows = [good, '{"value":"1.5","confidence":0.9}', '{"value":null,"confidence":0}', '{"value":null,"confidence":0.1}', '{"value":1,"confidence":2}', None]
    bad = spark.createDataFrame([(i, j) for i, j in enumerate(rows)], "i int, j string").select("i", merge._bad_value(F.col("j"), True).alias("b")).orderBy("i").collect()
    assert [r.b for r in bad] == [False, True, False, True, True, True]


def test_a_sample_that_all_documents_name_is_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(truth, "NAMED_TOGETHER", 4)
    docs = spark.range(40).selectExpr("cast(id AS string) AS document_id", "array('s-' || id, 'x', NULL) AS sample_ids")
    samples = spark.sql("SELECT 's-' || id AS sample_id, id AS seed FROM range(10) UNION ALL SELECT 'x', -1L UNION ALL SELECT NULL, 5L")
    out = truth.first_sample(docs, samples)
    assert "_part" in _plan(out)
    assert {r.document_id: (r.sample_id, r.seed) for r in out.collect()} == {str(i): (f"s-{i}", i) if i < 10 else ("x", -1) for i in range(40)}


def test_tables_of_the_star_are_written_in_their_own_columns_without_a_shuffle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "star")
    monkeypatch.setattr(truth, "STAR", {"labels": truth.truth_labels, "sample_ids": truth.truth_sample_ids})
    docs = lambda ids: spark.createDataFrame([({"document_id": x, "labels": {"a": "A"}, "sample_ids": [x, "s"]},) for x in ids], "d struct<document_id: string, labels: map<string,string>, sample_ids: array<string>>")
    truth.write_truth_star(docs(["d1", "d2"]), path, "01")
    truth.write_truth_star(docs(["d3"]), path, "a/b=c", stored=True)
    truth.write_truth_star(docs(["d4"]), path, "01")
    read = lambda name: sorted(map(tuple, truth.read_truth_star(spark, path, name).collect()))
    assert read("labels") == [("d3", "a", "A", "a/b=c"), ("d4", "a", "A", "01")]
    assert read("sample_ids") == [("d3", 1, "d3", "a/b=c"), ("d3", 2, "s", "a/b=c"), ("d4", 1, "d4", "01"), ("d4", 2, "s", "01")]
    assert spark.read.parquet(f"{path}/labels").columns == ["document_id", "label_key", "label_text", "batch", "version"]


def test_evidence_is_made_where_it_is_read(spark, monkeypatch):
    for name in ("_json", "check_evidence"):
        monkeypatch.setattr(decide, name, lambda *a, **b: F.udf(lambda: "{}", "string")())
    inv = _invoices(spark)
    matches = spark.sql("SELECT cast(id AS string) AS doc_id, id AS ap_id, 1.0D AS similarity, 'vendor_po' AS match_strategy FROM range(1, 3)")
    h = match.hydrate_context(fx.normalized(inv), matches, fx.ap_records(inv))
    out = decide.decide(h)
    assert "BatchEvalPython" in _plan(out.select("checks"))
    assert "BatchEvalPython" not in _plan(out.select("doc_id", "decision"))
    assert {r.doc_id: r.decision for r in out.select("doc_id", "decision").collect()} == {"1": "approve_partial_consumption", "2": "approve_with_tolerance", "3": "needs_review"}


def test_only_open_invoices_ask_the_next_tier(spark, monkeypatch):
    keys = spark.createDataFrame(
        [("a", "o", "x", "P", "1", None, None), ("b", "o", "x", "Q", "1", None, None), ("c", "o", "", "", "9", None, None),
         # rows of one id are one invoice: the purchase order of the second settles both
         ("d", "o", "x", "", "1", None, None), ("d", "o", "x", "P", "", None, None), (None, "o", "x", "P", "", None, None), (None, "o", "x", "", "1", None, None)],
        "doc_id string, owner string, vendor string, po string, number string, amount decimal(12,2), day date")
    ap = spark.createDataFrame(
        [(1, "o", "x", "P", None, None, None, None), (2, "o", "x", None, "1", None, None, None), (3, "o", "y", None, "9", None, None, None)],
        "id long, owner_user_id string, normalized_vendor string, normalized_purchase_order string, normalized_invoice_number string, invoice_total decimal(12,2), issue_date date, updated_at timestamp")
    asking, ask = [], match._ask
    monkeypatch.setattr(match, "_ask", lambda state, *rest: asking.append(sorted(str(r.doc_id) for r in state.collect())) or ask(state, *rest))
    got = {r.doc_id: (r.ap_id, r.match_strategy) for r in match.match_ap_context(keys, ap).collect()}
    assert got == {"a": (1, "vendor_po"), "b": (2, "vendor_invoice_number"), "c": (3, "invoice_number"), "d": (1, "vendor_po"), None: (1, "vendor_po")}
    assert asking == [["None", "None", "a", "b", "c", "d", "d"], ["b", "c"], []]


def test_intermediate_tables_of_matching_go_with_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "work_dir", lambda _: str(tmp_path))
    inv = _invoices(spark)
    out = match.match_ap_context(match.match_keys(fx.normalized(inv)), fx.ap_records(inv))
    assert out.count() == 3
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["matches"]


def test_normalized_invoices_are_not_moved_whole(spark):
    inv = _invoices(spark)
    matches = spark.sql("SELECT cast(id AS string) AS doc_id, id AS ap_id, 1.0D AS similarity, 'vendor_po' AS match_strategy FROM range(1, 3)")
    h = match.hydrate_context(fx.normalized(inv.repartition(4, "doc_id")), matches, fx.ap_records(inv.repartition(4, "k")))
    moved = h._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")[1:]
    # the rows they are made of, matches, and contexts once
    assert len(moved) == 4


def test_every_kind_of_white_space_is_trimmed(spark):
    marks = [chr(i) for i in (*range(9, 14), 28, 32, 133, 160, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    rows = spark.createDataFrame([(f"{m}{m} a{m}b{m}\n",) for m in marks] + [(m,) for m in marks] + [("",), (None,)], "s string")
    old = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    assert rows.filter(~text.strip_ws(F.col("s")).eqNullSafe(old)).count() == 0
    assert "regexp" not in _plan(rows.select(text.strip_ws(F.col("s"))))


def _items(spark):
    return spark.sql("""
        SELECT k, cast(i AS int) AS line, k AS suppkey, i AS partkey, 'steel bolt' AS description, cast(2 AS decimal(12,2)) AS quantity,
          cast(10 AS decimal(12,2)) AS amount, cast(5 AS decimal(12,2)) AS unit_price, cast(0 AS decimal(4,2)) AS discount_rate,
          cast(0 AS decimal(4,2)) AS tax_rate, date'2026-01-02' AS ship_date
        FROM (SELECT id AS k FROM range(1, 4)) CROSS JOIN (SELECT id AS i FROM range(1, 3))""")


def _small(spark, monkeypatch):
    """The catalog over small rows; tables it stores are refused."""
    def refused(*_):
        raise AssertionError("stored")

    monkeypatch.setattr(fx, "invoices", lambda spark, sf: _invoices(spark))
    monkeypatch.setattr(fx, "line_items", lambda spark, sf: _items(spark))
    monkeypatch.setattr(catalog, "materialize", refused)


def test_words_that_lie_together_are_neither_moved_nor_stored(spark, monkeypatch):
    _small(spark, monkeypatch)
    out = catalog.QUERIES["w06_build_lines"](spark, "small")
    plan = out._jdf.queryExecution().executedPlan().toString()
    made = plan.index("posexplode(split")
    # between words and lines nothing moves; only counts do after
    assert "Window" in plan[:made] and "Exchange" not in plan[plan.index("Window"):made]
    assert {tuple(r) for r in out.collect()} == {(str(k), 14 + 1 + 2 + 2 + 1 + 2 - 4) for k in (1, 2, 3)}
    rows = lambda **how: sorted(map(repr, fx.rendered_words(_invoices(spark), _items(spark), **how).collect()))
    assert rows() == rows(spread=3)


def test_words_of_a_line_are_sorted_once(spark):
    words = spark.createDataFrame([("a", 1, "b", 10.0, 0.0, 19.0, 8.0, None), ("a", 1, "a", 0.0, 1.0, 9.0, 9.0, None), ("a", 1, " ", 0.0, 40.0, 9.0, 48.0, None)], WORD)
    lines = grid.build_lines(words).select("line_no", "text")
    assert lines._jdf.queryExecution().executedPlan().toString().count("slice(") == 1
    assert [tuple(r) for r in lines.collect()] == [(1, "a b")]


def test_who_reads_labels_only_does_not_read_amounts(spark, monkeypatch):
    _small(spark, monkeypatch)
    out = catalog.QUERIES["j14_match_labels"](spark, "small")
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.label: r.n for r in out.collect()}
    lines = grid.match_labels(grid.build_lines(fx.rendered_words(_invoices(spark), _items(spark))))
    assert got == {r.label: r["count"] for r in lines.select(F.explode("hits.label").alias("label")).groupBy("label").count().collect()}
    assert got["date"] == 6 and got["purchase order"] == 3 and got["invoice no"] == 3
