"""Choosing among readings of the same field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billgrid.functions.text import squeeze, text_or_empty
from billgrid.schemas import ALTERNATIVE

def stage(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters on derived columns are normally pushed below the projection that derives them,
    which copies long expressions into the filter, once per reference and per step. A
    generator is where that stops, so each staged value is computed once.
    """
    keep = [c for c in df.columns if c not in cols]
    made = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*keep, F.explode(F.array(made)).alias("_staged")).select(*keep, "_staged.*")


#: columns of a candidate; ``seq`` is its place in reading order
RECORD = ("raw", "value", "amount", "currency", "page", "bbox", "label", "confidence", "method", "ambiguity_reasons")


def compare_key(amount: Column, value: Column, raw: Column) -> Column:
    text = F.coalesce(amount.cast("string"), value, raw)
    return F.lower(F.trim(squeeze(text_or_empty(text))))


def best_candidate(cands: DataFrame, max_alternatives: int | None = 5) -> DataFrame:
    """The most confident reading per (doc_id, field), lower on the page on ties.

    Marks it ambiguous (``reason``) when readings differ and the runner-up is within 0.08,
    unless the winner's confidence reaches ``ceiling``. Of the other values
    ``max_alternatives`` are kept for display, all if it is None.
    ``cands`` carries RECORD plus doc_id, field, seq (array<int>), reason, ceiling.

    The winner is a mergeable aggregate and the alternatives are a limited rank, so a field
    with very many readings never gathers in one place.
    """
    keyed = cands.withColumn("_cmp", compare_key(F.col("amount"), F.col("value"), F.col("raw"))).withColumn(
        "_order",
        F.struct(
            "confidence",
            F.coalesce(F.get("bbox", 3), F.lit(0.0)).alias("bottom"),
            F.transform("seq", lambda x: -x).alias("first"),
        ),
    )
    filled = F.when(F.col("_cmp") != "", F.col("_cmp"))
    winners = keyed.groupBy("doc_id", "field").agg(
        F.max_by(F.struct(*RECORD, "_cmp", "reason", "ceiling"), "_order").alias("w"),
        F.max("_order").alias("_top"),
        (F.min(filled) < F.max(filled)).alias("_differs"),
    )
    others = keyed.select("doc_id", "field", "_cmp", "_order", F.struct(*[F.col(c) for c in RECORD if c != "ambiguity_reasons"]).alias("alt")).join(
        winners.filter("_differs").select("doc_id", "field", "_top", F.col("w._cmp").alias("_wcmp")),
        ["doc_id", "field"],
    ).filter(F.col("_order") != F.col("_top"))
    runner_up = others.groupBy("doc_id", "field").agg(F.max("_order.confidence").alias("_second"))
    rank = Window.partitionBy("doc_id", "field").orderBy(F.desc("_order"))
    alternatives = (
        others.filter((F.col("_cmp") != "") & (F.col("_cmp") != F.col("_wcmp")))
        .withColumn("_r", F.row_number().over(rank))
        .filter(F.lit(True) if max_alternatives is None else F.col("_r") <= max_alternatives)
        .groupBy("doc_id", "field")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "alt"))).alias("_alts"))
        .select("doc_id", "field", F.transform("_alts", lambda a: a["alt"]).cast(f"array<{ALTERNATIVE}>").alias("alternatives"))
    )
    ambiguous = (
        F.col("_differs")
        & (F.col("w.ceiling").isNull() | (F.col("w.confidence") < F.col("w.ceiling")))
        & (F.col("w.confidence") - F.col("_second") <= 0.08 + 1e-12)
    )
    reasons = F.when(
        ambiguous, F.array_union(F.col("w.ambiguity_reasons"), F.array("w.reason"))
    ).otherwise(F.col("w.ambiguity_reasons"))
    return (
        winners.join(runner_up, ["doc_id", "field"], "left")
        .join(alternatives, ["doc_id", "field"], "left")
        .select(
            "doc_id", "field", *[F.col(f"w.{c}").alias(c) for c in RECORD if c != "ambiguity_reasons"],
            reasons.alias("ambiguity_reasons"), "alternatives",
        )
    )


def weak_geometry(confidence: Column, threshold: float = 0.85) -> Column:
    return F.when(confidence < threshold, F.array(F.lit("weak_geometry"))).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def top_per_key(df: DataFrame, keys, order, n: int) -> DataFrame:
    """The first ``n`` rows per key. The limit is pushed below the shuffle by Spark."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_per(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_per_key(df, keys, order, 1)
