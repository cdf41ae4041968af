import datetime
import glob
import json
import os
import shutil

from pyspark.sql import functions as F

from billgrid import session
from billgrid.sources import keyed
from billgrid.streaming import continuous, events, state

WORK = "unique_key string, type string, seq long"


def test_live_work_waits_and_durable_work_enters_once(spark, tmp_path):
    src, known, out, ck = (str(tmp_path / d) for d in ("in", "known", "out", "ck"))
    live = {"now": ["b"]}
    batches = [[("a", "parse_pdf", 1), ("b", "sync", 2), ("c", "sync", 3)], [("a", "parse_pdf", 4), ("b", "sync", 5), ("c", "sync", 6)], [("a", "parse_pdf", 7), ("b", "sync", 8), ("d", "parse_pdf", 9)]]
    got = []
    for rows, active in zip(batches, (["b"], ["c"], [])):
        live["now"] = active
        spark.createDataFrame(rows, WORK).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(WORK).parquet(src)
        continuous.admit_stream(stream, known, out, ck, lambda: spark.createDataFrame([(k,) for k in live["now"]], "unique_key string")).awaitTermination()
        rows = spark.read.parquet(out)
        got.append(sorted(r.unique_key for r in rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]).collect()))
    assert got == [["a", "c"], ["b"], ["b", "d"]]


def test_the_newest_decision_of_each_document(spark, tmp_path):
    out = str(tmp_path / "decisions")
    for batch, rows in enumerate([[("a", "x"), ("b", "x")], [("b", "y")], [("c", "z"), ("a", "w")], [("c", "z"), ("a", "w")]]):
        made = spark.createDataFrame(rows, "doc_id string, decision string")
        table = continuous.decisions_table(spark, out, made, 4)
        table.upsert_latest(made.withColumn("batch", F.lit(min(batch, 2)).cast("long")), "batch", min(batch, 2))  # the last one is replayed
    assert continuous.latest_decisions(spark, out).columns == ["doc_id", "decision"]
    assert {r.doc_id: r.decision for r in continuous.latest_decisions(spark, out).collect()} == {"a": "w", "b": "y", "c": "z"}


def test_rejected_notifications_keep_their_row(spark):
    rows = [(1, 7, "k", None), (2, 7, "k", None), (3, None, None, "no_message"), (4, None, None, "no_subscription")]
    routed = spark.createDataFrame(rows, "id long, account_id long, event_key string, rejected string")
    assert {r.id: r.outcome for r in events.notification_outcomes(routed).collect()} == {1: "accepted", 2: "duplicate", 3: "rejected", 4: "rejected"}


def test_scratch_tables_go(spark):
    base = session.work_dir(spark).removeprefix("file:")
    with session.scratch(spark):
        assert session.materialize(spark.range(3), "t").count() == 3
        inside = [d for d in os.listdir(base) if d.startswith("scratch-")]
        assert len(inside) == 1
    assert not [d for d in os.listdir(base) if d.startswith("scratch-")]


def _arrive(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_admission_by_state_over_restarts_and_late_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    at = lambda m: datetime.datetime(2024, 1, 1, 12, m)
    batches = [
        [("a", "parse_pdf", 1, at(0), None), ("b", "sync", 2, at(0), None), ("b", "sync", 3, at(1), None), ("c", "sync", 4, at(0), None)],
        # a durable key never returns, b's twin is live, c has ended
        [("a", "parse_pdf", 5, at(2), None), ("b", "sync", 6, at(3), None), ("c", "sync", 7, at(2), True), ("c", "sync", 8, at(3), None)],
        # late rows: a new durable key enters whatever its time, b's twin still counts; one hour on b has timed out
        [("d", "parse_pdf", 9, datetime.datetime(2023, 1, 1), None), ("b", "sync", 10, at(0), None), ("b", "sync", 11, datetime.datetime(2024, 1, 1, 14), None), (None, "sync", 12, None, None), ("a", "parse_pdf", 13, at(4), True), ("a", "parse_pdf", 14, at(5), None)],
    ]
    got, sizes = [], []
    for rows in batches:  # each run is a restart from the checkpoint
        _arrive(spark, rows, state.WORK, src)
        q = state.run_to_end(state.admit_by_state(spark.readStream.schema(state.WORK).parquet(src), 3600), out, ck)
        got.append(sorted(r.seq for r in spark.read.parquet(out).collect()))
        sizes.append(state.state_size(q)["rows"])
    assert got == [[1, 2, 4], [1, 2, 4, 8], [1, 2, 4, 8, 9, 11, 12]]
    assert sizes[0] >= 3 and sizes[-1] >= sizes[0]


def test_first_events_by_state_equal_the_batch_operator(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "id long, provider string, account_id long, event_key string"
    rows = [(k, "gmail" if k % 2 else "outlook", None if k % 5 == 0 else k % 3, f"e{k % 7}") for k in range(60)]
    for part in (rows[:20], rows[20:21], rows[21:], rows[:5]):  # the last rows come once more
        _arrive(spark, part, schema, src)
        state.run_to_end(state.first_by_state(spark.readStream.schema(schema).parquet(src)), out, ck)
    want = events.first_events(spark.createDataFrame(rows, schema)).select("provider", "account_id", "event_key", "id")
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, want.collect()))


def test_known_keys_read_only_their_buckets_and_stay_few_files(spark, tmp_path):
    path = str(tmp_path / "known")
    log, seen = keyed.KeyLog(spark, path, buckets=3, most_parts=4), set()
    for n in range(50):
        batch = spark.createDataFrame([(f"k{(n * 7 + j) % 90}",) for j in range(4)], "unique_key string")
        known = {r[0] for r in log.known(batch, n).collect()}
        keys = {f"k{(n * 7 + j) % 90}" for j in range(4)}
        assert keys & known == keys & seen
        log.add(spark.createDataFrame([(k,) for k in sorted(keys - known)], "unique_key string"), n)
        seen |= keys
        if n in (3, 30):  # a batch that is run again meets only the earlier ones
            assert {r[0] for r in log.known(batch, n).collect()} & keys == keys & known
            log.add(spark.createDataFrame([(k,) for k in sorted(keys - known)], "unique_key string"), n)
    assert len(keyed.children(spark, path, "key_bucket=*/part=*")) <= 3 * 6
    assert {r[0] for r in spark.read.parquet(path).select("unique_key").collect()} == seen
    one = spark.createDataFrame([("k1",)], "unique_key string")
    plan = log.known(one, 99)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and len({r[0] for r in log.known(one, 99).collect()}) < len(seen)


def test_a_stored_table_replaces_only_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id long, v long, s string"
    table = keyed.KeyedTable(spark, path, spark.createDataFrame([], schema).schema, ["id"], 8)
    rows = lambda t: sorted(tuple(r) for r in t.read().collect())
    assert rows(table) == []
    table.upsert_latest(spark.createDataFrame([(k, 0, "x") for k in range(40)], schema), "v", 0)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/key_bucket=*/*.parquet")}
    update = spark.createDataFrame([(3, 5, "y"), (3, 7, None), (100, 1, "z"), (None, 1, "n")], schema)
    table.upsert_latest(update, "v", 1)
    want = sorted([(k, 0, "x") for k in range(40) if k != 3] + [(3, 7, None), (100, 1, "z")])
    assert [r for r in map(tuple, table.read().collect()) if r[0] is None] == [(None, 1, "n")]
    assert sorted(tuple(r) for r in table.read().filter("id is not null").collect()) == want
    kept = [f for f in before if os.path.exists(f)]
    assert len(kept) >= 5 and all(os.path.getmtime(f) == before[f] for f in kept)
    table.upsert_latest(update, "v", 1)  # a replay
    whole = {tuple(r) for r in table.read().collect()}
    # a replay after a failure in the middle: old partitions are gone, new ones not in place
    for b in keyed.children(spark, f"{path}.staged/batch=000000000001", "key_bucket=*"):
        shutil.rmtree(f"{path}/{b}")
    assert len({tuple(r) for r in table.read().collect()}) < len(whole)
    table.upsert_latest(update, "v", 1)
    assert {tuple(r) for r in table.read().collect()} == whole
    table.upsert_coalesce(spark.createDataFrame([(4, None, "q"), (200, 9, None)], schema), ["v"], 2)
    got = {r.id: tuple(r) for r in table.read().collect()}
    assert got[4] == (4, 0, "q") and got[200] == (200, 9, None)
    table.upsert_columns(spark.createDataFrame([(4, 11, "no")], schema), ["v"], 3)
    assert {r.id: tuple(r) for r in table.read().collect()}[4] == (4, 11, "q")
    assert keyed.children(spark, f"{path}.staged") == ["batch=000000000003"]
    table.upsert_latest(spark.createDataFrame([], schema), "v", 4)
    assert {r.id: tuple(r) for r in table.read().collect()}[4] == (4, 11, "q")


def _page(folder, account, since, cursor, **more):
    os.makedirs(f"{folder}/account_id={account}", exist_ok=True)
    n = len(os.listdir(f"{folder}/account_id={account}"))
    with open(f"{folder}/account_id={account}/{n:06d}.jsonl", "w") as f:
        f.write(json.dumps({"since": since, "cursor": cursor, **more}) + "\n")


def test_a_feed_resumes_at_each_accounts_cursor(spark, tmp_path):
    feed, out, ck = (str(tmp_path / d) for d in ("feed", "out", "ck"))
    _page(feed, 1, None, 10)
    _page(feed, 2, None, 5)
    run = lambda: continuous.sync_history(spark, feed, out, ck).awaitTermination()
    read = lambda name: sorted(r[0] for r in spark.read.parquet(f"{out}/{name}").select("unique_key").collect()) if glob.glob(f"{out}/{name}/batch=*") else []
    run()  # both accounts are new: rescans, no work
    assert read("rescans") == ["gmail-fallback:1:missing-history", "gmail-fallback:2:missing-history"] and read("work") == []
    _page(feed, 1, 10, 11, added=["a", "b"])
    _page(feed, 1, 11, 12, touched=["b", "c", None])
    run()  # a restart
    assert read("work") == ["gmail-message:1:a", "gmail-message:1:b", "gmail-message:1:c"]
    _page(feed, 1, 12, 13, added=["d"])
    _page(feed, 2, 8, 9, added=["lost"])  # the feed no longer goes on from 5
    _page(feed, 3, None, 1)
    run()
    run()  # nothing new
    assert read("work") == [f"gmail-message:1:{m}" for m in "abcd"]
    assert read("rescans") == ["gmail-fallback:1:missing-history", "gmail-fallback:2:missing-history", "gmail-fallback:2:stale:5", "gmail-fallback:3:missing-history"]
    _page(feed, 2, 9, 10, added=["found"])
    run()
    assert read("work") == [f"gmail-message:1:{m}" for m in "abcd"] + ["gmail-message:2:found"]
    last = spark.read.parquet(f"{out}/cursors").groupBy("account_id").agg(F.max_by("cursor", "batch").alias("c")).collect()
    assert {r.account_id: r.c for r in last} == {1: "13", 2: "10", 3: "1"}


def test_a_delta_feed_gives_the_rows_of_the_batch_operator(spark, tmp_path):
    feed, out, ck = (str(tmp_path / d) for d in ("feed", "out", "ck"))
    message = lambda k: {"id": f"m{k}", "removed": k % 4 == 0, "has_attachments": k % 3 != 0}
    for account in (1, 2):
        _page(feed, account, None, 0)
    continuous.sync_delta(spark, feed, out, ck).awaitTermination()
    rows = []
    for k in range(12):
        _page(feed, 1 + k % 2, k // 2, k // 2 + 1, messages=[message(k), message(k + 50)], delta_link=f"l{k}")
        rows.append((1 + k % 2, k, [tuple(message(x).values()) for x in (k, k + 50)], f"l{k}"))
        if k in (4, 11):
            continuous.sync_delta(spark, feed, out, ck).awaitTermination()
    pages = spark.createDataFrame(rows, "account_id long, page_no long, messages array<struct<id:string,removed:boolean,has_attachments:boolean>>, delta_link string")
    want = sorted(r.unique_key for r in events.delta_to_messages(pages)[0].collect())
    assert sorted(r.unique_key for r in spark.read.parquet(f"{out}/work").collect()) == want
