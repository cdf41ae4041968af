"""Near-duplicate vectors: iterative quantisation codes, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.llm import common

COSINE, TABLES, KEY_BITS, ROUNDS, FIT_ROWS = 0.9, 8, 16, 50, 10_000
#: Least chance that some table retrieves a pair at the threshold, on each kind of near pair a fit is tried on.
RECALL, PAIRS = 0.97, 4000
#: Members of one class in one bucket from which on the bucket is dealt out in blocks.
HOT = 4096
#: Pairs whose codes are compared in one numpy step.
CELLS = 500_000


def _near_pairs(x: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold, by kind: made from unit vectors ``x`` and differences of two others, made
    with noise in all directions, and found in ``x`` itself (where there are enough to count)."""
    kinds = []
    at = rng.integers(0, len(x), PAIRS)
    for noise in (x[rng.integers(0, len(x), PAIRS)] - x[rng.integers(0, len(x), PAIRS)], rng.normal(size=(PAIRS, x.shape[1]))):
        a = x[at]
        noise = noise - (noise * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        if some.sum() >= PAIRS // 2:
            kinds.append((a[some], COSINE * a[some] + math.sqrt(1 - COSINE**2) * noise[some] / size[some]))
    left, right = [], []
    some = x[rng.permutation(len(x))]
    for start in range(0, len(some), 500):
        i, j = np.nonzero(np.abs(some[start : start + 500] @ some.T - COSINE - 0.01) <= 0.01)
        i, j = i[i + start < j], j[i + start < j]
        left.append(some[start + i])
        right.append(some[j])
        if sum(map(len, left)) >= PAIRS:
            break
    if sum(map(len, left)) >= 100:
        left, right = np.concatenate(left), np.concatenate(right)
        pick = rng.permutation(len(left))[:PAIRS]
        kinds.append((left[pick], right[pick]))
    return kinds


class Codes:
    """Rotations of one vector length: ``rotations`` x ``bits`` sign bits, in tables of ``key_bits``.

    There are at least ``tables`` of them, and as many more as it takes to retrieve a share of RECALL of
    each kind of near pair: wider keys and vectors with a large mean need more. The radius follows from
    the bits in which the same pairs differ.
    """

    def __init__(self, sample: np.ndarray, n: int, tables: int = TABLES, rounds: int = ROUNDS, seed: int = 7) -> None:
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        held = x
        if 100 <= len(x) < n:  # vectors that a rotation was fitted to lie nearer its corners than others do
            held, x = x[::4], np.delete(x, np.s_[::4], 0)
        dim = x.shape[1]
        self.bits = min(dim, 64)
        self.key_bits = min(self.bits, max(KEY_BITS, math.ceil(math.log2(max(n, 2)))))  # buckets grow with the vectors
        self.per_rotation = self.bits // self.key_bits
        self.mean = x.mean(0)
        axes = np.linalg.eigh((x - self.mean).T @ (x - self.mean))[1].T[::-1]  # principal axes, the widest first
        v = (x - self.mean) @ axes[: self.bits].T
        rng = np.random.default_rng(seed)
        pairs = _near_pairs(held, np.random.default_rng(seed + 1)) if n > 1 else []
        met, differing = [np.zeros(len(a), bool) for a, _ in pairs], [np.zeros(len(a), np.int64) for a, _ in pairs]
        self.maps = []
        mask, gained = np.uint64((1 << self.key_bits) - 1), True
        while len(self.maps) * self.per_rotation < tables or any(m.mean() < RECALL for m in met):
            r = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0]
            for _ in range(rounds if gained else 0):  # nearest corners of the cube, then the rotation that brings them nearest
                u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            self.maps.append(axes[: self.bits].T @ r)
            before = sum(int(m.sum()) for m in met)
            for k, (a, b) in enumerate(pairs):
                diff = self._signs(a, self.maps[-1:])[:, 0] ^ self._signs(b, self.maps[-1:])[:, 0]
                differing[k] += np.bitwise_count(diff)
                for t in range(self.per_rotation):
                    met[k] |= np.bitwise_count((diff >> np.uint64(t * self.key_bits)) & mask) <= 1
            gained = sum(int(m.sum()) for m in met) > before  # a fit that repeats another is followed by one left to chance
        self.tables = len(self.maps) * self.per_rotation
        #: Share of each kind of near pair that some table retrieves.
        self.recall = [float(m.mean()) for m in met]
        share = math.acos(COSINE) / math.pi
        total = len(self.maps) * self.bits
        #: Differing bits beyond which a pair at the threshold lies with a chance of a few in a million.
        self.radius = math.ceil(max([total * share + 4.5 * math.sqrt(total * share * (1 - share)), *(d.mean() + 4.5 * d.std() for d in differing)]))

    def _signs(self, x: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
        weights = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        return np.stack([np.where((x - self.mean) @ m > 0, weights, np.uint64(0)).sum(1, dtype=np.uint64) for m in maps], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._signs(x / np.linalg.norm(x, axis=1, keepdims=True), self.maps)


def usable(embedding: Column) -> Column:
    """Not null, empty or zero, and all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _sized(embedding: Column) -> Column:
    """Vectors whose squares would leave the range of doubles, brought to a largest component of 1;
    all others as they are. A vector's cosines don't depend on its length."""
    largest = F.array_max(F.transform(embedding, F.abs))
    return F.when((largest > 0) & (largest < float("inf")) & ~largest.between(1e-100, 1e100), F.transform(embedding, lambda x: x / largest)).otherwise(embedding)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fit(distinct: DataFrame, rows: int = FIT_ROWS) -> dict[int, Codes]:
    """Codes for every length of vector, fitted on a hash sample of about ``rows`` of each length."""
    sizes = {r.dim: r.n for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # lengths are few
    models = {}
    for dim, n in sorted(sizes.items()):
        some = distinct.filter((F.col("dim") == dim) & (F.pmod("cid", F.lit(max(1, n // rows))) == 0)).orderBy("cid").limit(2 * rows)
        x = some.select("v").toArrow().column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        if len(x):
            models[dim] = Codes(x, n)
    return models


def _coded(distinct: DataFrame, models: dict[int, Codes]) -> DataFrame:
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column("dim").to_pylist(), batch.column("v").to_pylist()
            codes: list = [None] * len(dims)
            for dim in set(dims):
                at = [k for k, d in enumerate(dims) if d == dim]
                for k, c in zip(at, shared.value[dim](np.array([vectors[k] for k in at], dtype=np.float64)).view(np.int64).tolist()):
                    codes[k] = c
            yield pa.record_batch({"cid": batch.column("cid"), "dim": batch.column("dim"), "code": pa.array(codes, pa.list_(pa.int64()))})

    return distinct.select("cid", "dim", "v").mapInArrow(run, "cid long, dim int, code array<long>")


def _keys(coded: DataFrame, models: dict[int, Codes]) -> DataFrame:
    """One row for each table: (dim, t, key)."""
    parts: Column = F.array().cast("array<struct<t:int,key:bigint,bits:int>>")
    for dim, m in models.items():
        here = F.array(*[F.struct(F.lit(t).alias("t"), F.shiftrightunsigned(F.col("code")[t // m.per_rotation], t % m.per_rotation * m.key_bits).bitwiseAND(F.lit((1 << m.key_bits) - 1)).alias("key"), F.lit(m.key_bits).alias("bits")) for t in range(m.tables)])
        parts = F.when(F.col("dim") == dim, here).otherwise(parts)
    return coded.select("*", F.explode(parts).alias("e")).select(*coded.columns, "e.t", "e.key", "e.bits")


def _differing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _classes(coded: DataFrame, distinct: DataFrame, models: dict[int, Codes], threshold: float) -> DataFrame:
    """cid, cls: tight classes. A member lies within half the threshold's angle of the vector cls,
    so any two members of a class are linked, without forming their pairs.

    In every bucket the least vector is offered as the centre; a vector takes the least centre it is
    near enough to, unless that one has a centre itself.
    """
    keys = _keys(coded, models)
    centres = common.stored(keys.groupBy("dim", "t", "key").agg(F.min(F.struct("cid", "code")).alias("c"), F.count("*").alias("n")).filter("n > 1").drop("n"), "centres")
    offers = keys.join(centres, ["dim", "t", "key"]).filter(F.col("cid") != F.col("c.cid")).select("cid", F.col("c.cid").alias("centre"), _differing("code", "c.code").alias("bits"))
    radius = max((m.radius for m in models.values()), default=0)
    offers = offers.filter(F.col("bits") <= radius).select("cid", "centre").distinct()
    v, w = distinct.select("cid", "v"), distinct.select(F.col("cid").alias("centre"), F.col("v").alias("w"))
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    near = common.stored(offers.join(v, "cid").join(w, "centre").filter(cosine(F.col("v"), F.col("w")) >= half).groupBy("cid").agg(F.min("centre").alias("cls")), "classes")
    return near.join(near.select(F.col("cid").alias("cls")), "cls", "left_anti").select("cid", "cls")


def _pairs(models: dict[int, Codes]):
    """Candidates among rows sorted by bucket: pairs of other classes within the radius."""

    def found(chunk: dict[str, np.ndarray], models: dict[int, Codes]) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.r_[True, np.any([chunk[c][1:] != chunk[c][:-1] for c in ("dim", "t", "key", "block")], axis=0)])
        size = np.diff(np.r_[start, len(chunk["t"])])
        base = np.add.reduceat(1 - chunk["visit"].astype(np.int64), start)  # base rows come first
        out_a, out_b = [], []
        # every base row meets the rows after it in its bucket
        rows = np.repeat(start, base) + common.ranges(base)
        after = np.repeat(start + size, base) - rows - 1
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(np.cumsum(after[at:]), CELLS)) + at)
            i = np.repeat(rows[at:end], after[at:end])
            j = i + 1 + common.ranges(after[at:end])
            keep = chunk["cls"][i] != chunk["cls"][j]
            keep &= (chunk["block"][i] == 0) | chunk["hot"][i] | chunk["hot"][j]
            i, j = i[keep], j[keep]
            if len(i):
                diff = chunk["code"][i] ^ chunk["code"][j]
                bits = np.bitwise_count(diff).sum(1)
                for dim in np.unique(chunk["dim"][i]):
                    m = models[int(dim)]
                    k = np.flatnonzero((chunk["dim"][i] == dim) & (bits <= m.radius))
                    first = np.ones(len(k), bool)  # no earlier table brings the pair together
                    for t in range(m.tables):
                        part = (diff[k, t // m.per_rotation] >> np.uint64(t % m.per_rotation * m.key_bits)) & np.uint64((1 << m.key_bits) - 1)
                        first &= (np.bitwise_count(part) > 1) | (t >= chunk["t"][i[k]])
                    k = k[first]
                    out_a.append(chunk["cid"][i[k]])
                    out_b.append(chunk["cid"][j[k]])
            at = end
        return np.concatenate([np.zeros(0, np.int64), *out_a]), np.concatenate([np.zeros(0, np.int64), *out_b])

    return found


def _candidates(coded: DataFrame, classes: DataFrame, models: dict[int, Codes]) -> DataFrame:
    """a, b: pairs of other classes whose codes agree in some table but for one bit, and differ in at
    most the radius, each once.

    A vector stands in its own bucket and visits those that lack one of its key's bits: of two keys
    that differ in one bit, exactly one lacks it. A class that fills a bucket is dealt over blocks, and
    only the bucket's other vectors are copied to each.
    """
    keys = _keys(coded.join(classes, "cid", "left").withColumn("cls", F.coalesce("cls", "cid")), models)
    lit_bits = F.filter(F.sequence(F.lit(0), F.col("bits") - 1), lambda b: F.getbit("key", b) == 1)
    visits = F.concat(F.array(F.struct("key", F.lit(0).alias("visit"))), F.transform(lit_bits, lambda b: F.struct((F.col("key") - F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias("key"), F.lit(1).alias("visit"))))
    rows = keys.select("cid", "cls", "code", "dim", "t", F.explode(visits).alias("e")).select("cid", "cls", "code", "dim", "t", "e.key", "e.visit")
    hot = rows.groupBy("dim", "t", "key", F.col("cls").alias("hot_cls")).agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    hot = common.stored(hot.groupBy("dim", "t", "key").agg(F.max(F.struct("n", "hot_cls")).alias("h")).select("dim", "t", "key", "h.hot_cls", F.ceil(F.col("h.n") / HOT).cast("int").alias("blocks")), "hot-buckets")
    rows = rows.join(hot, ["dim", "t", "key"], "left")
    is_hot = F.coalesce(F.col("cls") == F.col("hot_cls"), F.lit(False))
    blocks = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(is_hot, F.array(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("cid", "cls", "code", "dim", "t", "key", "visit", is_hot.alias("hot"), F.explode(blocks).alias("block"))
    bucket = ["dim", "t", "key", "block"]
    rows = rows.repartition(*bucket).sortWithinPartitions(*bucket, "visit", "cid")
    shared, pairs = coded.sparkSession.sparkContext.broadcast(models), _pairs(models)
    plain = ("cid", "cls", "dim", "t", "key", "visit", "hot", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def out(chunk: dict[str, np.ndarray]) -> pa.RecordBatch:
            a, b = pairs(chunk, shared.value)
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in plain}
            lists = batch.column("code")
            width = max(m.maps.__len__() for m in shared.value.values())
            code = np.zeros((batch.num_rows, width), np.uint64)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().view(np.uint64)
            code[np.repeat(np.arange(batch.num_rows), lengths), common.ranges(lengths)] = flat
            new["code"] = code
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            last = {c: held[c][-1] for c in bucket}
            cut = int(np.flatnonzero(np.any([held[c] != last[c] for c in bucket], axis=0))[-1]) + 1 if any((held[c] != last[c]).any() for c in bucket) else 0
            if cut:  # complete buckets
                yield out({c: x[:cut] for c, x in held.items()})
                held = {c: x[cut:] for c, x in held.items()}
        if held is not None:
            yield out(held)

    return rows.mapInArrow(run, "a long, b long")


def link(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one (told apart by a 64-bit hash of their components), with a weight. Vectors
    within half the threshold's angle of a centre form a class whose members are all linked; other
    links come from the Hamming tables and are reranked by the cosine in double precision, so none
    lies below the threshold. Links that no table brings together are missed: see the README for the
    recall. Vectors are compared with those of their length only.

    Null, empty and zero vectors and those with null or non-finite components have no link and are
    components of their own; null ids never name a component unless all its ids are null; repeated
    rows are vectors of their own, linked with each other; ties share the smallest id; an empty table
    gives an empty result; other columns are ignored.
    """
    cast = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _sized(cast).alias("v"))
    rows = rows.withColumn("cid", F.when(usable(F.col("v")), F.xxhash64("v"))).select("vec_id", "cid", "v")
    distinct = rows.filter("cid is not null").groupBy("cid").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    distinct = common.stored(distinct.withColumn("dim", F.size("v")), "distinct-vectors")
    models = fit(distinct)
    coded = common.stored(_coded(distinct, models), "codes")
    classes = common.stored(_classes(coded, distinct, models, threshold), "vector-classes") if models else coded.select("cid", F.col("cid").alias("cls")).limit(0)
    v, w = distinct.select(F.col("cid").alias("a"), F.col("v").alias("va")), distinct.select(F.col("cid").alias("b"), F.col("v").alias("vb"))
    asked = _candidates(coded, classes, models) if models else coded.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    crossing = common.stored(asked.join(v, "a").join(w, "b").filter(cosine(F.col("va"), F.col("vb")) >= threshold).select("a", "b"), "vector-links")

    weights = distinct.select("cid", "weight")
    of_class = distinct.join(classes, "cid", "left").select("cid", F.coalesce("cls", "cid").alias("cls"), "weight", "least")
    of_class = common.stored(of_class, "vector-members")
    totals = of_class.groupBy("cls").agg(F.sum("weight").alias("class_weight"))
    both = crossing.unionByName(crossing.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(weights.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("weight").alias("outside"))
    groups = common.components(classes.select(F.col("cid").alias("a"), F.col("cls").alias("b")).unionByName(crossing), "vector-components")
    marked = of_class.join(totals, "cls").join(outside, "cid", "left").join(groups.withColumnRenamed("id", "cid"), "cid", "left")
    marked = common.stored(marked.select("cid", (F.col("class_weight") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component_id", "cid").alias("component"), "least"), "vector-marks")
    leaders = marked.groupBy("component").agg(F.min("least").alias("component_id"))
    marked = common.stored(marked.join(leaders, "component").select("cid", "n_links", "component_id"), "vector-results")
    out = rows.select("vec_id", "cid").join(marked, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
