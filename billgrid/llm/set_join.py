"""N-gram Jaccard join with set-relation skipping.

Sets are ordered rarest shingle first, and only a prefix of each is indexed. Two relations between
sets save work: in an index list by size, a set's position bounds the sizes of its partners, so
all but one block is skipped; and a set that is much like another has its overlaps derived from
that one's, through the few shingles in which they differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.llm import common

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles of more indexed sets come last in every set's order; at most so many do. The order only
#: decides how many candidates there are, never which sets link.
FREQUENT, MOST_FREQUENT = 32, 200_000
#: Lists that offer a first partner: those of the least hashes of each set. A set and the leader of
#: a list are tried if they meet in SHARED of them, or in that part of a smaller set's.
LEADING, SHARED = 8, 3
#: Sets of one component in one index list from which on the list is dealt out in blocks.
HOT = 4096
#: Classes of shingles whose parity is told of each set.
PARITIES = 2048
#: Pairs formed in one numpy step.
CELLS = 500_000
#: Shingles that a task counts at a time, and sets after which it forgets which ones it has met.
COUNTED, KNOWN = 4_000_000, 1_000_000
#: 64-bit words of the bitmap that thins out texts before they are read again.
BITMAP = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_hashes = common.WordHashes()


def shingle_set(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words are one shingle."""
    w = _hashes.of(common.word_list(raw))
    if not len(w):
        return w
    w = common.mix(w)
    if len(w) < size:  # the number of words goes in, so that it is no shingle's hash
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = h * _STEP + x
        return common.mix(h)
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = h * _STEP + w[k : len(w) - size + 1 + k]
    return np.unique(common.mix(h))


def prefix_length(n: int) -> int:
    """Sets of n that link share one of their first so many shingles, in any order common to all."""
    return n - -(-PERCENT * n // 100) + 1


def set_id(s: np.ndarray) -> int:
    """64-bit hash of a set: equal sets are one."""
    return int(common.mix(np.array([np.add.reduce(common.mix(s ^ _STEP)) + np.uint64(len(s))])).view(np.int64)[0])


def parities(s: np.ndarray, classes: int = PARITIES) -> np.ndarray:
    """For each of ``classes`` classes of shingles, whether the set has an odd number of them, as 64-bit
    words: where two sets differ, a shingle is in one of them only."""
    odd = np.bincount((common.mix(s) % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def own_parities(s: np.ndarray) -> np.ndarray:
    """Parities of two to four classes for each shingle of a set too large for the common number. The
    classes are a power of two, so halves laid over each other are those of half as many classes."""
    return parities(s, 1 << (2 * len(s) - 1).bit_length()) if 2 * len(s) > PARITIES else s[:0]


def _apart(x: Column, y: Column) -> Column:
    """How many shingles at least are in one of two sets only, by parities of which one's classes may be
    some times the other's."""
    differing = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    size = F.least(F.size(x), F.size(y))
    folded = lambda x: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int") - 1), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get(x, k * size + i))))
    return F.when(size == 0, F.lit(0)).when(F.size(x) == F.size(y), differing(x, y)).otherwise(differing(folded(x), folded(y)))


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _signed(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(a) for a in arrays], dtype=np.int64)].astype(np.int32)), pa.array(flat))


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of the shingles that most sets have, counted over all documents and all shingles of each: a
    task counts a set once, and the shingles that it meets more than once among some thousands of sets."""

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"h": pa.array(h[n > 1].view(np.int64)), "n": pa.array(n[n > 1].astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, set()
        for batch in batches:
            for part in _slices(batch):
                for raw in _raw(part.column("text")):
                    if not (s := shingle_set(raw)).size or (rid := set_id(s)) in known:
                        continue
                    known.add(rid)
                    held.append(s)
                    size += len(s)
                if size > COUNTED:
                    yield repeated(held)
                    held, size = [], 0
                if len(known) > KNOWN:
                    known.clear()
        if held:
            yield repeated(held)

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT)
    most = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toArrow().column("h")
    return np.sort(most.to_numpy().view(np.uint64))


def _sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, row_key, n, rid, prefix, n_rare, heads, often, parity, own_parity of every row: its set's size and id,
    the first shingles in the common order, how many of those are not frequent, the least hashes, how
    many frequent shingles the set has, and its parities."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in _slices(batch):
                n, rid, prefix, rare, often_, heads, parity, own = [], [], [], [], [], [], [], []
                for raw in _raw(part.column("text")):
                    s = shingle_set(raw)
                    p = prefix_length(len(s)) if len(s) else 0
                    at = np.searchsorted(often, s)
                    common_ = often[np.minimum(at, len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)
                    first = s[~common_][:p]
                    n.append(len(s))
                    rid.append(set_id(s) if len(s) else None)
                    rare.append(len(first))
                    often_.append(int(common_.sum()))
                    heads.append(s[:LEADING])
                    parity.append(parities(s) if len(s) else s)
                    own.append(own_parities(s))
                    prefix.append(np.r_[first, s[common_][: p - len(first)]] if len(first) < p else first)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "row_key": part.column("row_key"), "n": pa.array(n, pa.int64()), "rid": pa.array(rid, pa.int64()), "prefix": _signed(prefix), "n_rare": pa.array(rare, pa.int64()), "heads": _signed(heads), "often": pa.array(often_, pa.int64()), "parity": _signed(parity), "own_parity": _signed(own)})

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key long, n long, rid long, prefix array<long>, n_rare long, heads array<long>, often long, parity array<long>, own_parity array<long>")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, s: the whole sets of ``wanted`` (rid, row_key), from one text each.

    A bitmap of the wanted keys, of at most BITMAP rows, thins out the texts before anything is moved;
    what it lets through by chance goes in the join.
    """
    word = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(F.lit(BITMAP - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row_key").bitwiseAND(F.lit(63)).cast("int"))
    bitmap = wanted.groupBy(word(F.col("row_key")).alias("word")).agg(F.bit_or(bit).alias("bits"))
    some = docs.withColumn("word", word(F.col("row_key"))).join(F.broadcast(bitmap), "word").filter(F.getbit("bits", F.col("row_key").bitwiseAND(F.lit(63)).cast("int")) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                sets = [shingle_set(x) for x in _raw(part.column("text"))]
                yield pa.record_batch({"row_key": part.column("row_key"), "s": _signed(sets)})

    found = some.select("row_key", "text").mapInArrow(run, "row_key long, s array<long>").dropDuplicates(["row_key"])
    return found.join(wanted, "row_key").select("rid", "s")


def _linked(overlap: Column, n: Column, m: Column) -> Column:
    return overlap * (100 + PERCENT) >= (n + m) * PERCENT


def _partners(distinct: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """rid, leader, gone, new: links of sets to the leaders of the lists of their least hashes, and in
    which shingles the two differ. A list's leader is the set with most frequent shingles: of copies
    with changes it is the one that is most like the others."""
    heads = distinct.select("rid", "n", "often", F.explode("heads").alias("h"))
    leaders = heads.groupBy("h").agg(F.max(F.struct("often", (-F.col("rid")).alias("r"), "rid", "n")).alias("l"), F.count("*").alias("c")).filter("c > 1")
    leaders = common.stored(leaders.select("h", F.col("l.rid").alias("leader"), F.col("l.n").alias("m")), "leaders")
    pairs = heads.join(leaders, "h").filter((F.col("rid") != F.col("leader")) & _linked(F.least("n", "m"), F.col("n"), F.col("m")))
    pairs = pairs.groupBy("rid", "n", "leader", "m").agg(F.count("*").alias("c")).filter(F.col("c") * LEADING >= F.least(F.lit(LEADING), "n", "m") * SHARED)
    pairs = common.stored(pairs.drop("c"), "leader-pairs")
    wanted = pairs.select("rid").unionByName(pairs.select(F.col("leader").alias("rid"))).distinct().join(sets.select("rid", "row_key"), "rid")
    whole = common.stored(_fetch(docs, wanted), "leader-sets")
    both = pairs.join(whole, "rid").join(whole.select(F.col("rid").alias("leader"), F.col("s").alias("t")), "leader")
    both = both.withColumn("overlap", F.size(F.array_intersect("s", "t"))).filter(_linked(F.col("overlap"), F.col("n"), F.col("m")))
    return both.select("rid", "leader", F.array_except("t", "s").alias("gone"), F.array_except("s", "t").alias("new"))


def _list_pairs(chunk: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Pairs of each list (sorted by shingle, block and position), a < b: their sizes, in how many lists
    of the chunk they meet, and their last places there.

    A pair that links has so many shingles in common that the first of them stands early in both: from
    there on each set still has as many. Only lists with such places tell of a pair. Their places are
    near as well: with p <= q the overlap is at most p + (m - q), so q - p is at most a third of n, and
    the list beyond that is skipped.
    """
    n, pos, rid, comp = chunk["n"], chunk["pos"].astype(np.int64), chunk["rid"], chunk["comp"]
    change = (chunk["h"][1:] != chunk["h"][:-1]) | (chunk["block"][1:] != chunk["block"][:-1])
    group = np.r_[0, np.cumsum(change)] if len(n) else np.zeros(0, np.int64)
    wide = int(pos.max() + n.max()) + 2
    end = np.searchsorted(group * wide + pos, group * wide + pos + n // 3, side="right")
    after = end - np.arange(len(n)) - 1
    rows = np.flatnonzero(after)
    out, at, steps = [], 0, np.cumsum(after[rows])
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + CELLS, side="right")))
        part = rows[at:stop]
        i = np.repeat(part, after[part])
        j = i + 1 + common.ranges(after[part])
        keep = (comp[i] != comp[j]) & ((chunk["block"][i] == 0) | chunk["hot"][i] | chunk["hot"][j])
        i, j = i[keep], j[keep]
        keep = np.minimum(n[i] - pos[i], n[j] - pos[j]) * (100 + PERCENT) >= (n[i] + n[j]) * PERCENT
        i, j = i[keep], j[keep]
        i, j = np.where(rid[i] < rid[j], i, j), np.where(rid[i] < rid[j], j, i)
        out.append(_merged(np.stack([rid[i], rid[j], n[i], n[j], np.ones(len(i), np.int64), pos[i], pos[j]])))
        at = stop
    return dict(zip(("a", "b", "n", "m", "k", "p", "q"), _merged(np.concatenate([np.zeros((7, 0), np.int64), *out], 1))))


def _merged(rows: np.ndarray) -> np.ndarray:
    """One column for each pair (rows 0 and 1): counts (row 4) added, places (rows 5 and 6) at most."""
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    start = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]) if rows.shape[1] else np.zeros(0, np.int64)
    if not len(start):
        return rows
    return np.concatenate([rows[:4, start], np.add.reduceat(rows[4], start)[None], np.maximum.reduceat(rows[5:], start, axis=1)])


def _candidates(rows: DataFrame, others: DataFrame, comps: DataFrame) -> DataFrame:
    """a, b: pairs of sets of other components that may link, each once.

    ``rows`` without ``others`` (row_key) are the distinct sets. What two sets have in common lies within
    the pair's prefixes (all but the last overlap - 1 shingles of either, for the overlap that it needs),
    where it is counted, or beyond the prefix that ends first and the last common place of the other:
    the rests there bound it. Of what is left, parities tell how many shingles at least are in one set
    only.
    """
    sets = rows.filter("rid is not null").select("row_key", "rid", "n", "n_rare", "prefix").join(others, "row_key", "left_anti")
    marked = sets.join(comps.select(F.col("id").alias("rid"), F.col("component_id").alias("comp")), "rid", "left")
    index = marked.select("rid", "n", "comp", "n_rare", F.posexplode("prefix").alias("pos", "h"))
    long_ = index.groupBy("h", F.coalesce("comp", "rid").alias("comp")).agg(F.count("*").alias("c")).filter(F.col("c") > HOT)
    long_ = common.stored(long_.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("m")).select("h", F.col("m.comp").alias("hot_comp"), F.ceil(F.col("m.c") / HOT).cast("int").alias("blocks")), "long-lists")
    if long_.isEmpty():
        index = index.select("rid", "n", "comp", "pos", "h", F.lit(False).alias("hot"), F.lit(0).alias("block"))
    else:
        hot = F.coalesce(F.coalesce("comp", "rid") == F.col("hot_comp"), F.lit(False))
        blocks = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(hot, F.array(F.pmod("rid", "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        index = index.join(long_, "h", "left").select("rid", "n", "comp", "pos", "h", hot.alias("hot"), F.explode(blocks).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.complete_groups(batches, ("rid", "n", "comp", "pos", "h", "hot", "block"), ("h", "block")):
            yield pa.record_batch({name: pa.array(x) for name, x in _list_pairs(chunk | {"comp": np.where(chunk["comp"] == 0, chunk["rid"], chunk["comp"])}).items()})

    lists = index.fillna(0, ["comp"]).repartition("h", "block").sortWithinPartitions("h", "block", "pos")
    met = lists.mapInArrow(run, "a long, b long, n long, m long, k long, p long, q long")
    met = met.groupBy("a", "b", "n", "m").agg(F.sum("k").alias("k"), F.max("p").alias("p"), F.max("q").alias("q"))
    after = F.ceil((F.col("n") + F.col("m")) * PERCENT / (100 + PERCENT)) - 1
    rest = F.greatest(F.least(after, F.col("m") - F.col("q") - 1), F.least(F.col("n") - F.col("p") - 1, after))
    met = met.filter(_linked(F.col("k") + rest, F.col("n"), F.col("m"))).select("a", "b", "n", "m")
    for parity in ("parity", "own_parity"):  # few words for all pairs, then as many as large sets need for those left
        told = rows.filter("rid is not null").select("row_key", "rid", parity).join(others, "row_key", "left_anti").dropDuplicates(["rid"])
        both = met.join(told.select(F.col("rid").alias("a"), F.col(parity).alias("x")), "a").join(told.select(F.col("rid").alias("b"), F.col(parity).alias("y")), "b")
        met = both.filter(_linked((F.col("n") + F.col("m") - _apart(F.col("x"), F.col("y"))) / 2, F.col("n"), F.col("m"))).select("a", "b", "n", "m")
        met = common.stored(met, f"pairs-by-{parity.replace('_', '-')}")
    return met.select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, partners: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that link. If b has a leader, the overlap of a and the leader is
    counted once for all its followers, and b's differs by what it lacks and adds."""
    near = partners.groupBy("rid").agg(F.min(F.struct("leader", "gone", "new")).alias("p")).select("rid", "p.*")
    near = common.stored(near, "followers")
    has = near.select(F.col("rid").alias("a"), F.lit(True).alias("a_follows"))
    turned = pairs.join(has, "a", "left").select(F.when(F.col("a_follows"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("a_follows"), F.col("a")).otherwise(F.col("b")).alias("b"))
    turned = turned.join(near.withColumnRenamed("rid", "b"), "b", "left").withColumn("head", F.coalesce("leader", "b"))
    turned = common.stored(turned.select("a", "b", "head", F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"), F.coalesce("new", F.array().cast("array<bigint>")).alias("new")), "candidates")
    wanted = turned.select(F.col("a").alias("rid")).unionByName(turned.select(F.col("head").alias("rid"))).distinct().join(sets.select("rid", "row_key"), "rid")
    whole = common.stored(_fetch(docs, wanted), "candidate-sets")
    s, t = whole.select(F.col("rid").alias("a"), "s"), whole.select(F.col("rid").alias("head"), F.col("s").alias("t"))
    heads = turned.select("a", "head").distinct().join(s, "a").join(t, "head").select("a", "head", F.size(F.array_intersect("s", "t")).alias("base"))
    size = sets.select("rid", "n")
    full = turned.join(common.stored(heads, "head-overlaps"), ["a", "head"]).join(s, "a").join(size.select(F.col("rid").alias("a"), "n"), "a").join(size.select(F.col("rid").alias("b"), F.col("n").alias("m")), "b")
    overlap = F.col("base") - F.size(F.array_intersect("s", "gone")) + F.size(F.array_intersect("s", "new"))
    return full.filter(_linked(overlap, F.col("n"), F.col("m"))).select("a", "b")


def join_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, group, row_key of every row of ``docs`` (doc_id, text); ``group``
    names a component (null without a set) and ``row_key`` is a hash of id and text.

    Equal sets are one set, so copies form no pairs; each set is first tried with the least set in the
    lists of its first shingles, and only sets of other components become candidates afterwards: a
    component is the same whichever of its links are found. No link between components is lost: every
    pair of the index that may link is verified with whole sets. Frequent shingles come last in the
    order, and a list full of one component is dealt over blocks.

    Rows with null texts or no words have no set, link with nothing and are components of their own;
    null ids name a component only if all its ids are null; repeated rows and ties share the smallest
    id; an empty table gives an empty result; other columns are ignored. Whole texts are used. Sets
    and shingles are told apart by 64-bit hashes.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows = common.stored(_sets(base, _frequent(base)), "shingle-sets")
    sets = rows.filter("rid is not null").groupBy("rid").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"))
    sets = common.stored(sets, "distinct-sets")
    # rows that repeat another's set: where they are few, the rows that stay are not moved
    others = common.stored(rows.select("rid", "row_key").join(sets.select("rid", F.col("row_key").alias("kept")), "rid").filter("row_key <> kept").select("row_key"), "other-rows")
    partners = common.stored(_partners(rows.select("rid", "n", "heads", "often", "row_key").filter("rid is not null").join(others, "row_key", "left_anti"), docs=base, sets=sets), "partners")
    first = partners.select(F.col("rid").alias("a"), F.col("leader").alias("b"))
    comps = common.components(first, "first-components")
    links = first.unionByName(_verified(_candidates(rows, others, comps), sets, partners, base))
    comps = common.components(common.stored(links, "set-links"), "set-components")
    named = sets.select("rid", "least").join(comps.withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("component_id", "rid")).drop("component_id")
    named = common.stored(named, "named-sets")
    of = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = common.stored(named.join(of, "comp").select("rid", F.col("comp").alias("group"), "component_id"), "set-results")
    out = rows.select("doc_id", "row_key", "n", "rid").join(found, "rid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group", "row_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that share a component with one of smaller id: one row of each stays.
    Rows without words stay all; null ids give way to others."""
    found = common.stored(join_groups(docs).select("doc_id", "group", "row_key"), "groups")
    kept = found.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("k")).select(F.col("k.row_key").alias("row_key"))
    kept = kept.unionByName(found.filter("group is null").select("row_key")).distinct()
    keyed = docs.select(F.struct("*").alias("given"), F.xxhash64(F.col("doc_id").cast("long"), common.whole_text()).alias("row_key"))
    rows = keyed.join(kept, "row_key", "left_semi")
    repeated = found.filter("group is not null").groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key")
    if not repeated.isEmpty():  # rows alike in id and text
        again = rows.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"])
        rows = rows.join(repeated, "row_key", "left_anti").unionByName(again)
    return rows.select("given.*")
