"""Vector codes: codebooks of whole-number parts, learned in rounds whose assignments are exact.

Every vector keeps, for each group of a codebook's entries, how far the group's nearest entry was
when it was last looked at (but for the vector's own entry), with the number of that round as stamp.
All codebooks of the past are kept, so an entry's net displacement since a stamp is known, which is
never more than the sum of its drifts. A group is looked at again only if that distance less the
group's largest net displacement does not exceed the distance to the vector's own entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that share one bound.
GROUP = 16
#: Rows whose distances are formed in one numpy step.
STEP = 4096
#: Whole numbers below which doubles hold every sum of squared distances.
EXACT = 2**53
#: Different labels up to which their sums go to every task.
FEW_LABELS = 100_000
#: A bound is taken a little lower and a displacement a little higher than doubles give them.
_LOWER, _HIGHER = 1 - 1e-6, 1 + 1e-9


def usable(c: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return c.isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vectors: pa.Array, width: int, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of each component, one row for each vector, zeros behind short ones. ``wide``:
    as Python's integers, else as doubles that hold them."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if wide:
        flat = np.array([int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale)) for x in flat.tolist()] or [0], object)[: len(flat)]
    else:
        flat = np.floor(flat * scale)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), common.ranges(sizes)] = flat
    return out


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to each entry."""
    if x.dtype == object:
        return np.array([[((a - c) ** 2).sum() for c in entries] for a in x], object).reshape(len(x), len(entries))
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def first_assignment(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the first of equals) of each row, its squared distance, and each group's bound."""
    starts = np.arange(0, len(book), GROUP)
    codes, errors, bounds = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), np.zeros((len(x), len(starts)), np.float32)
    for at in range(0, len(x), STEP):
        part = slice(at, at + STEP)
        far = squared(x[part], book)
        rows = np.arange(len(far))
        best = np.array([int(np.argmin(row)) for row in far]) if far.dtype == object else far.argmin(1)
        codes[part], errors[part] = best, far[rows, best]
        if far.dtype != object:
            far[rows, best] = np.inf
            bounds[part] = np.sqrt(np.minimum.reduceat(far, starts, axis=1)) * _LOWER
    return codes, errors, bounds


def displacements(books: list[np.ndarray]) -> np.ndarray:
    """For each past codebook, the largest net displacement of a group's entries until the last one."""
    starts = np.arange(0, len(books[-1]), GROUP)
    return np.stack([np.maximum.reduceat(np.sqrt(((books[-1] - old) ** 2).sum(1)), starts) * _HIGHER for old in books])


def next_assignment(x: np.ndarray, books: list[np.ndarray], codes: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``first_assignment`` for the last of ``books``, from the assignment to the one before it and the
    bounds and stamps of each group; also the new stamps and how many distances to entries it took."""
    book, now, n_groups = books[-1], len(books) - 1, bounds.shape[1]
    own = book[codes]
    best, error = codes.copy(), ((x - own) ** 2).sum(1)
    before = error.copy()
    kept_bounds, kept_stamps = bounds.astype(np.float64), stamps.copy()
    bounds = kept_bounds - displacements(books)[stamps, np.arange(n_groups)]
    limit = np.sqrt(error) * _HIGHER
    open_ = bounds <= limit[:, None]
    least, second, looked = np.full(bounds.shape, np.inf), np.full(bounds.shape, np.inf), 0
    for g in range(n_groups):
        rows = np.flatnonzero(open_[:, g])
        for at in range(0, len(rows), STEP):
            some = rows[at : at + STEP]
            far = squared(x[some], book[g * GROUP : (g + 1) * GROUP])
            looked += far.size
            near = far.argmin(1)
            value = far[np.arange(len(some)), near]
            far[np.arange(len(some)), near] = np.inf
            least[some, g], second[some, g] = value, far.min(1)
            near = near + g * GROUP
            better = (value < error[some]) | ((value == error[some]) & (near < best[some]))
            best[some], error[some] = np.where(better, near, best[some]), np.where(better, value, error[some])
    rows, group = np.arange(len(x)), best // GROUP
    # the own entry stays out of its group's bound: it is the group's least wherever the group was looked at
    seen = open_[rows, group]
    least[rows[seen], group[seen]] = second[rows[seen], group[seen]]
    kept_bounds[open_], kept_stamps[open_] = np.sqrt(least[open_]) * _LOWER, now
    # an entry left behind counts again; its group is bounded as of now
    left = (best != codes) & ~open_[rows, codes // GROUP]
    at = rows[left], codes[left] // GROUP
    kept_bounds[at], kept_stamps[at] = np.minimum(bounds[at], np.sqrt(before[left])) * _LOWER, now
    return best, error, np.nextafter(kept_bounds.astype(np.float32), np.float32(-np.inf)), kept_stamps, looked


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _table(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class _Codebooks:
    """All codebooks so far, by round and part, and how components are read."""

    def __init__(self, width: int, parts: int, scale: int, wide: bool, first: np.ndarray):
        self.width, self.parts, self.scale, self.wide = width, parts, scale, wide
        self.of_part = [[first[:, p * self.size : (p + 1) * self.size]] for p in range(parts)]

    @property
    def size(self) -> int:
        return self.width // self.parts

    def cut(self, vectors: pa.Array) -> list[np.ndarray]:
        x = whole_numbers(vectors, self.width, self.scale, self.wide)
        return [np.ascontiguousarray(x[:, p * self.size : (p + 1) * self.size]) for p in range(self.parts)]

    def written(self) -> str:
        """The last codebooks' components, decimal, by part, entry and position."""
        return ",".join(str(int(x)) for books in self.of_part for entry in books[-1] for x in entry)


def _assigned(rows: DataFrame, books: _Codebooks) -> DataFrame:
    """vec_id, label, embedding, codes, bounds, stamps, errors: nearest entries in the last codebooks."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    known = "codes" in fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes, errors, bounds, stamps = [], [], [], []
            held = {c: np.split(_table(batch.column(c), n), books.parts, axis=1) for c in (("codes", "bounds", "stamps") if known else ())}
            for p, x in enumerate(books.cut(batch.column("embedding"))):
                if known and not books.wide:
                    c, e, b, s, _ = next_assignment(x, books.of_part[p], held["codes"][p][:, 0].astype(np.int64), held["bounds"][p], held["stamps"][p].astype(np.int64))
                else:
                    c, e, b = first_assignment(x, books.of_part[p][-1])
                    s = np.full(b.shape, len(books.of_part[p]) - 1)
                for out, new in ((codes, c[:, None]), (errors, e), (bounds, b), (stamps, s)):
                    out.append(new)
            total = [int(x) for x in sum(errors)]
            yield pa.record_batch({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"), "embedding": batch.column("embedding"),
                "codes": _lists(np.concatenate(codes, 1), pa.int16()), "bounds": _lists(np.concatenate(bounds, 1), pa.float32()), "stamps": _lists(np.concatenate(stamps, 1), pa.int8()),
                "error": pa.array([x if x < 2**63 else None for x in total], pa.int64()),
            })

    schema = ", ".join(f"{c} {fields[c]}" for c in ("vec_id", "label", "embedding"))
    return rows.mapInArrow(run, f"{schema}, codes array<smallint>, bounds array<float>, stamps array<tinyint>, error long")


def _moved(state: DataFrame, books: _Codebooks) -> list[np.ndarray]:
    """The next codebooks: each entry becomes the floor of its parts' mean. A task adds up its own parts
    first, so that what is moved grows with tasks and entries, and the driver gets entries alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _table(batch.column("codes"), batch.num_rows).astype(np.int64)
            for p, x in enumerate(books.cut(batch.column("embedding"))):
                if sums is None:
                    n = len(books.of_part[p][-1])
                    sums, counts = np.zeros((books.parts, n, books.size), object if books.wide else np.int64), np.zeros((books.parts, n), np.int64)
                np.add.at(sums[p], codes[:, p], x if books.wide else x.astype(np.int64))
                counts[p] += np.bincount(codes[:, p], minlength=counts.shape[1])
        if counts is not None:
            p, j = np.nonzero(counts)
            yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(j, pa.int32()), "n": pa.array(counts[p, j]), "sums": pa.array([[str(v) for v in row] for row in sums[p, j].tolist()], pa.list_(pa.string()))})

    def add(key: tuple, pieces: Iterator[pa.Table]) -> Iterator[pa.Table]:
        n, total = 0, [0] * books.size
        for piece in pieces:
            n += sum(piece.column("n").to_pylist())
            for row in piece.column("sums").to_pylist():
                total = [a + int(b) for a, b in zip(total, row)]
        yield pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "entry": pa.array([key[1].as_py()], pa.int32()), "mean": pa.array([[str(t // n) for t in total]], pa.list_(pa.string()))})

    partial = state.select("embedding", "codes").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    if books.wide:
        means = partial.groupBy("part", "entry").applyInArrow(lambda key, table: next(add(key, iter([table]))), "part int, entry int, mean array<string>").collect()
        found = [(r.part, r.entry, [int(x) for x in r.mean]) for r in means]
    else:
        each = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        whole = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).groupBy("part", "entry").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums")).collect()
        found = [(r.part, r.entry, [int(x.s) // r.n for x in r.sums]) for r in whole]
    out = [books.of_part[p][-1].copy() for p in range(books.parts)]
    for p, j, mean in found:
        if mean:
            out[p][j] = mean
    return out


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, _Codebooks]:
    """vec_id, label, code, error of every usable row of ``vectors`` (vec_id, embedding, label), and the
    codebooks of all rounds.

    Every round is one pass over a stored table of vectors, codes and bounds, which replaces the table
    of the round before; no row is shuffled. Codebooks start as the parts of the smallest vec_ids
    (null ids last, ties by components). Rows whose vector is null or holds null or non-finite
    components are dropped; repeated rows and ids have rows of their own; fewer vectors than entries
    give as many entries; other columns are ignored; an empty table gives an empty result. Vectors
    shorter than the longest one, and a length that the parts don't divide, are filled up with zeros.
    Components from about 8,000 on are handled as Python's integers without bounds, slower and as
    exactly; an error beyond a long is null.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "label", "embedding").filter(usable(F.col("embedding")))
    size = F.size("embedding")
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x).cast("double")))
    width, most = kept.agg(F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.max(largest), F.lit(0.0))).first()
    width = -(-width // parts) * parts
    wide = 4 * (width // parts) * (most * scale + 1) ** 2 >= EXACT if most < 1e100 else True
    first = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "embedding").limit(entries).select("embedding").toArrow().column("embedding")
    books = _Codebooks(width, parts, scale, wide, whole_numbers(first, width, scale, wide) if len(first) else np.zeros((0, width)))
    if not len(first):
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).filter(F.lit(False)), books
    state, before = kept, None
    for k in range(rounds + 1):
        path = common.folder(spark, f"vector-codes-{k}")
        done = _assigned(state, books)
        (done if k < rounds else done.select("vec_id", "label", "codes", "error")).write.parquet(path)
        if before:
            _drop(spark, before)
        state, before = spark.read.parquet(path), path
        if k < rounds:
            for p, book in enumerate(_moved(state, books)):
                books.of_part[p].append(book)
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    return state.select("vec_id", "label", code.alias("code"), "error"), books


def label_errors(found: DataFrame) -> DataFrame:
    """``found`` (label, error, ...) with the sum of errors over equal labels; nulls are one label. A label
    with an error or a sum beyond a long has null."""
    sums = found.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).alias("sum"))
    sums = common.stored(sums.select(F.col("label").alias("of"), F.col("sum").try_cast("long").alias("label_error")), "label-errors")
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return found.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def digest(books: _Codebooks) -> str:
    return hashlib.sha256(books.written().encode()).hexdigest()
