"""Scoring extractions and decisions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.functions import text as tx
from billgrid.functions.money import money_equal, money_key

SCORED = ("invoice_number", "issue_date", "due_date", "currency", "seller", "buyer", "balance_due")


def truth_join(parsed: DataFrame, truth: DataFrame) -> DataFrame:
    """Extracted next to true values; only sources holding exactly one document count.

    ``truth``: source, doc_id, one column per scored field.
    """
    single = truth.groupBy("source").agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    t = truth.join(single, "source", "left_semi").select("source", "doc_id", *[F.col(c).cast("string").alias(f"true_{c}") for c in SCORED])
    return parsed.join(t, "doc_id")


def compare_fields(joined: DataFrame) -> DataFrame:
    """One row per (doc_id, field) with ``matched``. ``joined`` has the wide field structs."""
    def same(c: str) -> Column:
        if c == "balance_due":
            return money_equal(F.col("balance_due.amount"), F.col("true_balance_due"))
        have = F.col(f"{c}.value")
        if c in ("seller", "buyer"):
            have = F.get(F.split(have, "\n"), 0)
        return tx.canonical(have) == tx.canonical(F.col(f"true_{c}"))

    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(same(c), F.lit(False)).alias("matched")) for c in SCORED])
    return joined.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.field", "r.matched")


def compare_line_items(actual: DataFrame, truth: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether items equal the truth in number, order and all four values.

    Both sides: doc_id, index, description, quantity, unit_price, amount. Items meet by
    position, so no document's items are gathered.
    """
    c = ("description", "quantity", "unit_price", "amount")
    a = actual.select("doc_id", "index", *[F.col(x).alias(f"a_{x}") for x in c], F.lit(True).alias("_a"))
    t = truth.select("doc_id", "index", *[F.col(x).alias(f"t_{x}") for x in c], F.lit(True).alias("_t"))
    ok = (
        F.col("_a").isNotNull() & F.col("_t").isNotNull()
        & (tx.canonical(F.col("a_description")) == tx.canonical(F.col("t_description")))
        & money_equal(F.col("a_quantity"), F.col("t_quantity")) & money_equal(F.col("a_unit_price"), F.col("t_unit_price"))
        & money_equal(F.col("a_amount"), F.col("t_amount"))
    )
    each = a.join(t, ["doc_id", "index"], "full_outer").groupBy("doc_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("matched"))
    return docs.select("doc_id").join(each, "doc_id", "left").select(
        "doc_id", F.lit("line_items").alias("field"), F.coalesce("matched", F.lit(True)).alias("matched")
    )


def _accuracy(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count_if("matched").alias("matched"), F.count("*").alias("total"),
        F.round(F.count_if("matched") / F.count("*"), 4).alias("accuracy"),
    )


def field_accuracy(cmp: DataFrame) -> DataFrame:
    """A10."""
    return _accuracy(cmp, "field")


def tag_accuracy(cmp: DataFrame, tags: DataFrame) -> DataFrame:
    """A11. ``tags``: doc_id, tag. Comparisons are counted per document before tags multiply them."""
    per_doc = cmp.groupBy("doc_id").agg(F.count_if("matched").alias("m"), F.count("*").alias("n"))
    return per_doc.join(tags.select("doc_id", "tag").distinct(), "doc_id").groupBy("tag").agg(
        F.sum("m").alias("matched"), F.sum("n").alias("total"), F.round(F.sum("m") / F.sum("n"), 4).alias("accuracy")
    )


def line_item_prf(actual: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 over items as multisets of (description, amount)."""
    key = lambda df, n: df.groupBy(
        "doc_id", tx.canonical(F.col("description")).alias("k"), money_key(F.col("amount")).alias("m")
    ).agg(F.count("*").alias(n))
    both = key(actual, "a").join(key(truth, "t"), ["doc_id", "k", "m"], "full_outer").fillna(0, ["a", "t"])
    s = both.agg(F.sum(F.least("a", "t")).alias("tp"), F.sum("a").alias("p"), F.sum("t").alias("e"))
    precision = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)
    recall = F.when(F.col("e") > 0, F.col("tp") / F.col("e")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return s.select(
        F.col("tp").alias("matched_rows"), F.col("p").alias("predicted_rows"), F.col("e").alias("expected_rows"),
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Histogram of a status or route column."""
    return df.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


#: Error of a quantile sketch: one rank in so many. Rows of a range that are counted out one by one.
ACCURACY, FEW = 10_000, 10_000


def value_at(values: DataFrame, rank: int) -> float | None:
    """The value (column ``v``, not null) of a rank from 1, null if there are fewer.

    A mergeable sketch names a narrow range around the rank, exact counts of what lies below confirm
    it, and so on inside it until few rows or one value are left: no pass sorts or moves the values.
    """
    inside, before, lo, hi = values, 0, None, None
    n = values.count()
    if not 1 <= rank <= n:
        return None
    while n > FEW:
        at = (rank - before) / n
        around = [max(0.0, at - 3 / ACCURACY), min(1.0, at + 3 / ACCURACY)]
        low, high = inside.agg(F.percentile_approx("v", around, ACCURACY).alias("q")).first().q
        below, within = inside.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not before + below < rank <= before + below + within:  # the sketch missed it: keep the side it is on
            side = F.col("v") < low if rank <= before + below else F.col("v") > high
            inside, before = inside.filter(side), before if rank <= before + below else before + below + within
        elif low == high:
            return low
        elif (low, high) == (lo, hi):  # two frequent values: their own rows go
            first, last = inside.agg(F.count_if(F.col("v") == low), F.count_if(F.col("v") == high)).first()
            if rank <= before + first:
                return low
            if rank > before + n - last:
                return high
            inside, before = inside.filter((F.col("v") > low) & (F.col("v") < high)), before + first
        else:
            inside, before, lo, hi = inside.filter(F.col("v").between(low, high)), before + below, low, high
        n = inside.count()
    rest = inside.orderBy("v").limit(rank - before).select("v").tail(1)
    return rest[0].v


def latency_summary(df: DataFrame, column: str = "duration_ms") -> DataFrame:
    """Median, 95th (rank ``round(0.95 n + 0.5)``, half to even) and maximum; nulls don't count."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n, largest = values.agg(F.count("*"), F.max("v")).first()
    rank = min(n, max(1, round(0.95 * n + 0.5)))
    low, high, p95 = (value_at(values, r) for r in ((n + 1) // 2, n // 2 + 1, rank))
    row = df.sparkSession.range(1)
    double = lambda x: F.lit(x).cast("double")
    return row.select(F.round((double(low) + double(high)) / 2, 2).alias("p50"), F.round(double(p95), 2).alias("p95"), F.round(double(largest), 2).alias("max"))


def decision_agreement(decisions: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Decisions against expectations. Labels are compared literally unless aliased."""
    want = F.col("expected_decision")
    for old, new in (aliases or {}).items():
        want = F.when(F.col("expected_decision") == old, new).otherwise(want)
    missing = F.coalesce(want, F.lit("")) == ""
    return decisions.agg(
        F.count("*").alias("total"), F.count_if(~missing & (F.col("decision") == want)).alias("matches"),
        F.count_if(~missing & (F.col("decision") != want)).alias("mismatches"), F.count_if(missing).alias("missing_expected"),
    )


def parse_summary(parsed: DataFrame) -> DataFrame:
    """Totals over parsed documents (status, warnings, item_count)."""
    return parsed.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "parsed").alias("parsed"), F.count_if(~F.col("status").eqNullSafe(F.lit("parsed"))).alias("failed"),
        F.sum(F.size("warnings")).alias("warnings"), F.sum(F.coalesce("item_count", F.lit(0))).alias("line_items"),
    )


def warning_rows(parsed: DataFrame) -> DataFrame:
    """Every warning with its document."""
    return parsed.select("doc_id", F.explode("warnings").alias("warning"))
