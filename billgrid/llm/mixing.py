"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import random
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrid.llm import common

#: Documents that one flight handles; also the size from which on a source is one block.
BLOCK = 4000
#: Documents of each block, the smallest, that are left to the landing.
HELD = 16
WEIGHTS = (5.0, 2.0, 1.0)
_EPS = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target of every source of ``sized`` (source, size).

    Sources by code point, null last, get the weights in turn; ``share`` of all sizes is spread by
    weight; a target stops at ``most`` times its source's size and the excess is spread again.
    """
    if share > most:
        raise ValueError("the mix is larger than all sources may give")
    totals = common.stored(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs")), "source-sizes")
    # one row for each source: their order is found in one task
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*map(F.lit, weights))[(order % len(weights)).cast("int")]
    ranked = common.stored(totals.select("*", turn.alias("weight"), (F.col("source_size") * float(most)).alias("bound")), "source-ranks")
    level = 0.0  # what a unit of weight gets; it only rises as sources reach their bound
    while True:
        full = F.col("weight") * level >= F.col("bound")
        total, held, free = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        raised = (share * total - held) / free if free else level
        if raised <= level * (1 + 1e-12) or not free:
            break
        level = raised
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, F.col("bound")).alias("target"))


def flight(sizes: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Chances after the flight: at most two stay between 0 and 1.

    Two totals are kept exactly: the number of documents and their sizes. Three open documents
    leave one direction that changes neither, (s3-s2, s1-s3, s2-s1); the step goes along it or
    against it, to the first chance that becomes 0 or 1, by odds that keep every chance's mean.
    """
    p = list(chance)
    open_: list[int] = []
    for k in range(len(p)):
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = round(p[k])
            continue
        open_.append(k)
        while len(open_) >= 3:
            i, j, m = open_[-3:]
            a, b, c = sizes[m] - sizes[j], sizes[i] - sizes[m], sizes[j] - sizes[i]
            if a == b == c == 0:
                a, b = 1.0, -1.0
            up = min((((1 - p[x]) if u > 0 else p[x]) / abs(u) for x, u in ((i, a), (j, b), (m, c)) if u), default=0.0)
            down = min(((p[x] if u > 0 else (1 - p[x])) / abs(u) for x, u in ((i, a), (j, b), (m, c)) if u), default=0.0)
            step = up if rng.random() * (up + down) < down else -down
            for x, u in ((i, a), (j, b), (m, c)):
                p[x] += step * u
                if p[x] < _EPS or p[x] > 1 - _EPS:
                    p[x] = round(p[x])
            open_ = [x for x in open_ if 0 < p[x] < 1]
    return p


def landing(sizes: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Settles everything, the largest sizes first, in strata that halve.

    Each stratum has a flight of its own; what stays open in it, two documents at most, is drawn by
    its chance. The words drawn too many or too few are taken up by the chances of the smaller ones,
    so the total is missed by no more than a few of the smallest documents. The means stay: draws are
    right on average.
    """
    p = list(chance)
    strata: dict[int, list[int]] = {}
    for k, s in enumerate(sizes):
        strata.setdefault(int(s).bit_length(), []).append(k)
    over = 0.0
    left = sum(s for s, x in zip(sizes, p) if 0 < x < 1)
    for _, units in sorted(strata.items(), reverse=True):
        shift = -over / left if left else 0.0
        for k in units:
            if 0 < p[k] < 1:
                left -= sizes[k]
                moved = min(1.0, max(0.0, p[k] + shift)) - p[k]
                over += moved * sizes[k]
                p[k] += moved
        flown = flight([sizes[k] for k in units], [p[k] for k in units], rng)
        for k, x in zip(units, flown):
            p[k] = x
        for k in sorted((k for k in units if 0 < p[k] < 1), key=lambda k: -sizes[k]):
            # beside an error of the same order, what lessens it is taken
            x = round(p[k] - over / sizes[k]) if left == 0 else float(rng.random() < p[k])
            x = min(1.0, max(0.0, float(x)))
            over += (x - p[k]) * sizes[k]
            p[k] = x
    return p


def _flier(round_: int):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size"], kind="stable")
        rng = random.Random(f"{pdf.source_key.iloc[0]} {pdf.block.iloc[0]} {round_}")
        sizes, chance = pdf["size"].tolist(), pdf.chance.tolist()
        order = rng.sample(range(len(sizes)), len(sizes))
        run = landing
        if pdf.blocks.iloc[0] > 1:  # the smallest wait for the landing
            run, order = flight, sorted(order, key=lambda k: -sizes[k])[:-HELD]
            order = rng.sample(order, len(order))
        for k, x in zip(order, run([sizes[k] for k in order], [chance[k] for k in order], rng)):
            chance[k] = float(x)
        return pdf[["source_key", "key", "size"]].assign(chance=chance)

    return fly


def cube_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """``units`` (source_key, key, size, chance) with ``chosen`` 0 or 1: balanced sample of each source.

    Flights run in blocks of about ``block`` units and keep each block's totals; what they leave
    open, at most two units a block, goes into blocks of the next round with the block's HELD smallest
    units, until a source has one block, which lands. Blocks, order and random numbers follow from ``key`` alone, so reruns agree.
    """
    schema = "source_key string, key string, size double, chance double"
    settled, left, round_ = None, units.select("source_key", "key", "size", "chance"), 0
    while True:
        counts = common.stored(left.groupBy("source_key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
        blocked = left.join(counts, "source_key").withColumn("block", F.pmod(F.xxhash64("key", F.lit(round_)), F.col("blocks")).cast("int"))

        flown = common.stored(blocked.groupBy("source_key", "block").applyInPandas(_flier(round_), schema), f"flight-{round_}")
        done = flown.filter("chance <= 0 or chance >= 1")
        settled = done if settled is None else settled.unionByName(done)
        left, round_ = flown.filter("chance > 0 and chance < 1"), round_ + 1
        if left.isEmpty():
            return settled.select("source_key", "key", "size", F.col("chance").cast("int").alias("chosen"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of ``docs`` (doc_id, text, source),
    with source_key, key and i, which name the row.

    A source whose target is r times its size gives every document floor(r) times, and a balanced
    sample of its documents once more, drawn with chance r - floor(r); so no document exceeds
    ``most`` times its size and each source meets its target within the landing of the sample.

    Null sources are one source, the last; null and empty texts have size 0 and are never taken;
    repeated rows are drawn one by one (which of several identical rows gets the extra copy makes
    no difference); an empty table gives an empty result; other columns are ignored. Documents with
    equal ids but other texts are told apart by a hash of their text.
    """
    size = F.size(F.array_remove(F.split(common.whole_text(), common.SPACE_CLASS + "+"), "")).cast("long")
    sized = common.stored(docs.select("doc_id", "source", size.alias("size"), _source_key().alias("source_key"), _key().alias("key")), "sized")
    targets = source_targets(sized, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("base", F.floor(rate + _EPS).cast("int")).withColumn("chance", F.greatest(rate - F.col("base"), F.lit(0.0)))
    targets = common.stored(targets.select(_source_key().alias("source_key"), "source_size", "target", "base", "chance"), "targets")
    rows = sized.groupBy("source_key", "key", "doc_id", "size").agg(F.count("*").alias("n"))  # identical rows, numbered
    rows = rows.select("source_key", "key", "doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).join(targets, "source_key")
    unit = F.concat_ws(" ", "key", "i").alias("unit")
    drawn = cube_sample(rows.filter("size > 0 and chance > 0").select("source_key", unit.alias("key"), F.col("size").cast("double").alias("size"), "chance"), block)
    copies = F.when(F.col("size") > 0, F.col("base") + F.coalesce("chosen", F.lit(0))).otherwise(0).cast("int")
    out = rows.withColumn("unit", unit).join(drawn.select("source_key", F.col("key").alias("unit"), "chosen"), ["source_key", "unit"], "left").withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source_key", "key", "i")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _key() -> Column:
    return F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(common.whole_text()).cast("string"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Every row of ``docs`` as often as ``mixed`` takes it."""
    of = mixed.groupBy("source_key", "key").agg(F.sort_array(F.collect_list(F.struct("i", "copies"))).alias("of"))  # one entry for each identical row
    rows = docs.select(F.struct("*").alias("given"), _source_key().alias("source_key"), _key().alias("key"))
    order = Window.partitionBy("source_key", "key").orderBy(*[f"given.{c}" for c in docs.columns if c not in ("doc_id", "text", "source")], F.lit(0))
    met = rows.withColumn("i", F.row_number().over(order)).join(of, ["source_key", "key"])
    met = met.select("given", F.get("of", F.col("i") - 1)["copies"].alias("copies")).filter("copies > 0")
    return met.select("given", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("given.*")
