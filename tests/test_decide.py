"""Matching, validation and the decision cascade on small frames."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billgrid.operators import decide, evaluate, match, normalize, profile, queue
from billgrid.plans import fixtures as fx
from billgrid.sources import sinks, tables
from billgrid.streaming import events

SF = "/root/testdata/sf0.001"


def test_scenarios_reach_their_decisions(spark):
    """The eight procurement scenarios on clean invoices with lines and orders."""
    inv = fx.invoices(spark, SF).filter("k in (160, 161, 162, 163, 164, 165, 166, 167) or k in (24, 25, 28, 31)")
    inv = inv.filter("k % 11 != 0 and k % 13 != 0 and k % 17 != 0 and k % 19 != 0 and k % 23 != 0 and n_lines > 0")
    norm, ap = fx.normalized(inv), fx.ap_records(inv)
    out = decide.decide(match.hydrate_context(norm, match.match_ap_context(match.match_keys(norm), ap), ap))
    rows = out.select("doc_id", "decision", "expected_decision", "checks").collect()
    assert len(rows) >= 6
    for r in rows:
        assert r["decision"] == r["expected_decision"], r["doc_id"]
    partial = [r for r in rows if r["decision"] == "approve_partial_consumption"]
    # a fitting partial consumption ends the cascade before the total is compared
    assert all(r["checks"][-1]["id"] == "partial_po_consumption" for r in partial)
    full = [r for r in rows if r["decision"] == "approve"]
    assert all(len(r["checks"]) == 17 for r in full)


def test_typo_vendor_wins_over_unrelated_vendor(spark):
    keys = spark.createDataFrame(
        [("a", "o", "acme supples", "PO1000", "", None, None), ("b", "o", "", "PO1000", "", None, None), ("c", "o", "x", "", "", Decimal("5.00"), None),
         ("d", "o", "x", "", "", Decimal("5.00"), dt.date(2026, 1, 2)), ("e", "o", "x", "", "N1", Decimal("9.00"), None), ("f", "o", "x", "", "", Decimal("7.00"), None)],
        "doc_id string, owner string, vendor string, po string, number string, amount decimal(12,2), day date")
    t = dt.datetime(2026, 1, 1)
    ap = spark.createDataFrame(
        [(1, "o", "unrelated vendor", "PO1000", None, None, None, t + dt.timedelta(1)), (2, "o", "acme supplies", "PO1000", None, None, None, t),
         (3, "o", "y", None, None, Decimal("5.00"), None, t), (4, "o", "y", None, None, Decimal("5.00"), dt.date(2026, 1, 2), t),
         (5, "o", "x", "", "N1", Decimal("1.00"), None, t), (6, "other", "x", None, None, Decimal("7.00"), None, t)],
        "id long, owner_user_id string, normalized_vendor string, normalized_purchase_order string, normalized_invoice_number string, invoice_total decimal(12,2), issue_date date, updated_at timestamp")
    got = {r["doc_id"]: r for r in match.match_ap_context(keys, ap).collect()}
    assert (got["a"]["ap_id"], got["a"]["match_strategy"]) == (2, "fuzzy_vendor_po")
    assert (got["b"]["ap_id"], got["b"]["match_strategy"], got["b"]["similarity"]) == (1, "po", 0.0)
    assert got["c"]["match_strategy"] == "amount_date" and got["d"]["ap_id"] == 4
    assert got["e"]["match_strategy"] == "vendor_invoice_number"
    assert "f" not in got  # other owner's record


_KEYS = "doc_id string, owner string, vendor string, po string, number string, amount decimal(20,2), day date"
_AP = "id long, owner_user_id string, normalized_vendor string, normalized_purchase_order string, normalized_invoice_number string, invoice_total decimal(20,2), issue_date date, updated_at timestamp"


def test_amounts_of_any_size_match(spark):
    t, large = dt.datetime(2026, 1, 1), Decimal("12345678901.50")
    keys = spark.createDataFrame([("a", "o", "x", "", "", large, None), ("b", "o", "x", "", "", Decimal("5.00"), None), ("c", "o", "x", "", "", Decimal("12345678901.51"), None)], _KEYS)
    ap = spark.createDataFrame([(1, "o", "x", None, None, large, None, t), (2, "o", "x", None, None, Decimal("5.00"), None, t)], _AP)
    assert {r.doc_id: r.ap_id for r in match.match_ap_context(keys, ap).collect()} == {"a": 1, "b": 2}


def test_bounds_rule_out_most_names_and_change_nothing(spark):
    """Every question of a hot key against every offer, by comparing all of them."""
    from difflib import SequenceMatcher

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    vendors = [f"{word(7)} {word(6)}" for _ in range(120)] + ["", "ünïcode 商事", "a", "aa ltd"]
    asked = [v[:3] + word(1) + v[3:] for v in vendors[:60]] + [word(9) for _ in range(20)] + ["zz", "ünicode 商", "ltd aa"]
    t = dt.datetime(2026, 1, 1)
    keys = spark.createDataFrame([(f"d{k}", "o", v, "P", "", None, None) for k, v in enumerate(asked)], _KEYS)
    ap = spark.createDataFrame([(k, "o", v, "P", None, None, None, t + dt.timedelta(k)) for k, v in enumerate(vendors)], _AP)
    got = {r.doc_id: (r.ap_id, r.similarity) for r in match.match_ap_context(keys, ap).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    for k, a in enumerate(asked):
        best = max((ratio(a, b), j) for j, b in enumerate(vendors))
        assert got[f"d{k}"] == (best[1], round(best[0], 3)), a
    questions = spark.createDataFrame([("o", 1, "P", "P", 0, v) for v in asked], "owner string, tier int, key string, q string, sub int, vendor string")
    offers = spark.createDataFrame([("o", 1, "P", v) for v in vendors], "owner string, tier int, key string, ap_vendor string")
    assert match.contenders(questions, offers).count() < 0.3 * len(asked) * len(vendors)


def test_all_records_of_a_key_compete(spark):
    """Fifty records of one key, the oldest of the very vendor, the second of a like one."""
    t = dt.datetime(2026, 1, 1)
    keys = [("a", "acme"), ("b", "acme tools"), ("c", ""), ("d", "beta industries")]
    keys = spark.createDataFrame([(i, "o", v, "P", "", None, None) for i, v in keys], "doc_id string, owner string, vendor string, po string, number string, amount decimal(12,2), day date")
    vendor = {0: "acme", 1: "acme tool", 2: None}
    ap = spark.createDataFrame(
        [(i, "o", vendor.get(i, f"zz{i}"), "P", None, None, None, t + dt.timedelta(i)) for i in range(50)] + [(99, "o", "acme", "P", None, None, None, t - dt.timedelta(9))],
        "id long, owner_user_id string, normalized_vendor string, normalized_purchase_order string, normalized_invoice_number string, invoice_total decimal(12,2), issue_date date, updated_at timestamp")
    got = {r["doc_id"]: (r["ap_id"], r["match_strategy"]) for r in match.match_ap_context(keys, ap).collect()}
    assert got["a"] == (0, "vendor_po") and got["b"] == (1, "fuzzy_vendor_po") and got["c"] == (49, "po") and got["d"][1] == "po"


def test_manifest_context_defaults(spark, tmp_path):
    doc = {
        "document_id": "d1", "invoice_number": "INV-7", "purchase_order": None, "currency": "USD", "seller": {"name": "Acme Inc", "tax_id": "T1"},
        "buyer": {"name": "Beta LLC"}, "issue_date": {"value": "2026-07-01"}, "due_date": {"value": "2026-07-31"}, "sample_ids": ["ledger-clean-a4-9-2-p1"],
        "amounts": {"balance_due": {"value": "100.00"}},
        "ap_context": {"scenario": "s", "context": {
            "prior_invoice": {"invoice_number": "INV-7", "vendor_name": "Acme"}, "previous_related_document": {"invoice_number": "INV-7", "vendor_name": "Acme"},
            "client_database": {"previous_related_documents": [{"invoice_number": "8", "database": "client", "document_id": "c"}]},
            "candidate_open_po": {"po_number": "PO-IMPLIED", "authorized_total": "90"}}},
    }
    (tmp_path / "a.manifest.json").write_text(json.dumps({"schema_version": 1, "suite": "x", "pdf": {"filename": "a.pdf", "page_count": 1}, "documents": [doc]}))
    docs = tables.read_manifests(spark, str(tmp_path))
    c = match.ap_records_from_documents(docs, "me").collect()[0]
    ctx = c["context"]
    assert c["source_key"] == "manifest:a.manifest.json:d1" and c["normalized_vendor"] == "acme"
    assert ctx["purchase_order"]["po_number"] == "PO-IMPLIED" and ctx["purchase_order"]["authorized_total"] == Decimal("90.00")
    assert ctx["purchase_order"]["remaining_before_invoice"] == Decimal("100.00")
    assert ctx["tolerance_policy"]["amount"] == Decimal("1.80")
    assert len(ctx["previous_invoices"]) == 2 and len(ctx["duplicate_candidates"]) == 1


def test_page_profiles(spark):
    words = [("d", 1, f"word-{i}", 10.0, 10.0, 30.0, 18.0, None) for i in range(25)] + [("d", 3, w, 10.0, 10.0, 30.0, 18.0, None) for w in ("one", "two", "three")]
    from billgrid.schemas import PAGE, WORD

    pages = spark.createDataFrame([("d", 1, 1.0, 1.0, "native", 100), ("d", 2, 1.0, 1.0, "", 0), ("d", 3, 1.0, 1.0, "sparse", 20)], PAGE)
    rows = profile.profile_pages(spark.createDataFrame(words, WORD), pages).orderBy("page").collect()
    assert [r["route"] for r in rows] == ["native_text", "local_ocr", "hybrid"]
    assert rows[1]["reasons"] == ["no_usable_native_text"] and rows[2]["reasons"] == ["sparse_native_text"]


def test_alias_map_for_expected_labels(spark):
    df = spark.createDataFrame([("needs_review", "route_over_tolerance_review"), ("approve", "approve"), ("approve", None)], "decision string, expected_decision string")
    plain = evaluate.decision_agreement(df).collect()[0]
    assert (plain["matches"], plain["mismatches"], plain["missing_expected"]) == (1, 1, 1)
    assert evaluate.decision_agreement(df, {"route_over_tolerance_review": "needs_review"}).collect()[0]["matches"] == 2


def test_replace_batch_leaves_other_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch, n in (("a", 2), ("b", 3), ("a", 1)):
        sinks.replace_batch(spark.range(n), path, batch)
    assert {r["batch_id"]: r["count"] for r in spark.read.parquet(path).groupBy("batch_id").count().collect()} == {"a": 1, "b": 3}


def test_upsert_coalesce_keeps_known_values(spark):
    t = spark.createDataFrame([(1, "a", "x", "bad")], "id int, cur string, v string, err string")
    u = spark.createDataFrame([(1, None, "y"), (2, "n", "z")], "id int, cur string, v string")
    rows = {r["id"]: r for r in sinks.upsert_coalesce(t, u, ["id"], ["cur"], {"err": None}).collect()}
    assert (rows[1]["cur"], rows[1]["v"], rows[1]["err"]) == ("a", "y", None) and rows[2]["cur"] == "n"


def test_stream_dedupe_across_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "provider string, account_id long, event_key string, id long"
    spark.createDataFrame([("g", 1, "k", 1), ("g", None, "k", 2), ("g", None, "k", 3)], schema).coalesce(1).write.json(src)

    def run():
        stream = spark.readStream.schema(schema).json(src)
        q = events.dedupe_events(stream).writeStream.format("json").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([("g", 1, "k", 4), ("g", 2, "k", 5)], schema).coalesce(1).write.mode("append").json(src)
    run()
    assert spark.read.json(out).count() == 3


def test_work_stream_admits_durable_work_once(spark, tmp_path):
    from billgrid.streaming.continuous import admit_stream

    src, out, ck, known = (str(tmp_path / x) for x in ("in", "out", "ck", "known"))
    schema = "unique_key string, seq long, type string"
    spark.createDataFrame([], "unique_key string, batch long").write.parquet(known + "/part-start")
    spark.createDataFrame([("a", 1, "parse_pdf"), ("a", 2, "parse_pdf"), ("b", 3, "gmail_history_sync")], schema).coalesce(1).write.json(src)
    read = lambda: spark.readStream.schema(schema).json(src)
    admit_stream(read(), known, out, ck).awaitTermination()
    spark.createDataFrame([("a", 4, "parse_pdf"), ("b", 5, "gmail_history_sync")], schema).coalesce(1).write.mode("append").json(src)
    admit_stream(read(), known, out, ck).awaitTermination()
    rows = sorted((r["unique_key"], r["seq"]) for r in spark.read.parquet(out).collect())
    assert rows == [("a", 1), ("b", 3), ("b", 5)]


def test_received_between_keeps_undated_without_bounds(spark):
    df = spark.createDataFrame([(1, None), (2, dt.datetime(2026, 1, 5))], "id int, at timestamp")
    assert queue.received_between(df, "at").count() == 2
    assert [r["id"] for r in queue.received_between(df, "at", "2026-01-05", "2026-01-05").collect()] == [2]
