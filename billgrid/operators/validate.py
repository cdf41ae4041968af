"""Validation of extracted fields (V1-V5, U3), on one wide row per document.

A wide row has a struct column per field and the mergeable item facts of
``extract.item_facts``; nothing here needs a second pass over the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.functions import lexicon as lx
from billgrid.functions.text import display_increment

CHECK = "struct<id:string,status:string,blocking:boolean,reason:string>"


def increment(f: Column) -> Column:
    """Printed step of a money field; an absent field counts as cents."""
    return F.when(f.isNull(), F.lit(0.01)).otherwise(display_increment(f["raw"]))


def _check(name: str, status: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(name).alias("id"), status.alias("status"), (status == "fail").alias("blocking"),
        F.when(status != "pass", reason).alias("reason"),
    ).cast(CHECK)


def _amount(key: str) -> Column:
    return F.col(f"{key}.amount")


def check_date_order() -> Column:
    """V1: the due date does not precede the issue date."""
    i, d = F.col("issue_date.value"), F.col("due_date.value")
    issue, due = F.try_to_date(i, "yyyy-MM-dd"), F.try_to_date(d, "yyyy-MM-dd")
    absent = (F.coalesce(i, F.lit("")) == "") | (F.coalesce(d, F.lit("")) == "")
    broken = issue.isNull() | due.isNull()
    status = F.when(absent, "skipped").when(broken, "fail").when(due < issue, "fail").otherwise("pass")
    reason = F.when(absent, None).when(broken, "invalid_normalized_date").otherwise("due_date_precedes_issue_date")
    return _check("date_order", status, reason)


def _close(a: Column, b: Column, tolerance: Column) -> Column:
    """Within tolerance, or within a relative 1e-9 that absorbs binary rounding."""
    return F.abs(a - b) <= F.greatest(tolerance, F.greatest(F.abs(a), F.abs(b)) * 1e-9)


def composed_balance() -> Column:
    zero = lambda k: F.coalesce(_amount(k), F.lit(0.0))
    return _amount("subtotal") - F.abs(zero("discount")) + zero("tax") + zero("shipping") - zero("paid")


def check_amount_composition() -> Column:
    """V2: subtotal, discount, tax, shipping and payments make up the balance."""
    # one lambda for all: written out for each key, the row's code grew too long to be compiled
    printed = F.array(*[F.struct(F.col(k).isNotNull().alias("there"), F.col(k)["raw"].alias("raw")) for k in lx.MONEY_KEYS])
    half_steps = F.aggregate(printed, F.lit(0.0), lambda s, m: s + F.when(m["there"], display_increment(m["raw"]) / 2).otherwise(0.0))
    balance = _amount("balance_due")
    tolerance = F.greatest(F.lit(0.02), F.abs(balance) * 0.001, half_steps)
    absent = _amount("subtotal").isNull() | balance.isNull()
    status = F.when(absent, "skipped").when(_close(composed_balance(), balance, tolerance), "pass").otherwise("fail")
    return _check("amount_composition", status, F.when(~absent, F.lit("balance_due_does_not_reconcile")))


def check_line_item_sum() -> Column:
    """V3: item amounts add up to the subtotal, when every item has one."""
    n = F.coalesce(F.col("item_count"), F.lit(0))
    subtotal = _amount("subtotal")
    absent = (n == 0) | subtotal.isNull()
    incomplete = F.col("item_amounts") != n
    tolerance = F.greatest(
        F.lit(0.02), F.abs(subtotal) * 0.001, F.col("item_half_steps") + increment(F.col("subtotal")) / 2
    )
    status = (
        F.when(absent | incomplete, "skipped")
        .when(_close(F.col("item_total"), subtotal, tolerance), "pass")
        .otherwise("fail")
    )
    reason = F.when(absent, None).when(incomplete, "incomplete_line_amounts").otherwise("line_items_do_not_match_subtotal")
    return _check("line_item_sum", status, reason)


def observed_currencies() -> Column:
    own = F.array_compact(F.array(*[F.upper(F.col(k)["currency"]) for k in lx.MONEY_KEYS]))
    items = F.coalesce(F.col("item_currencies"), F.expr("cast(array() as array<string>)"))
    return F.filter(F.array_distinct(F.concat(own, items)), lambda c: c != "")


def currency_conflicts(expected: Column) -> Column:
    """Currencies seen on amounts other than the document's, sorted."""
    return F.array_sort(F.array_except(observed_currencies(), F.array(expected)))


def check_currency() -> Column:
    """V4: all amounts carry the document's currency."""
    expected = F.upper(F.coalesce(F.col("currency.value"), F.lit("")))
    status = F.when(expected == "", "skipped").when(F.size(currency_conflicts(expected)) > 0, "fail").otherwise("pass")
    return _check("currency_consistency", status, F.when(expected != "", F.lit("conflicting_currency_evidence")))


def with_validations(wide: DataFrame) -> DataFrame:
    """V5: ``validations`` array and ``failures``, the ids of blocking ones."""
    checks = F.array(check_date_order(), check_amount_composition(), check_line_item_sum(), check_currency())
    return wide.withColumn("validations", checks).withColumn(
        "failures",
        F.transform(F.filter("validations", lambda c: c["blocking"]), lambda c: c["id"]),
    )
