"""Importance resampling: documents are drawn by how much their hashed n-grams resemble a target.

Texts are cut into lines at newlines, which separate words anyway. A distinct line's n-grams are
counted once and multiplied by how often the line occurs, its gain is added up once and goes to
every document that holds it; n-grams that reach over a newline are added document by document.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billgrid.llm import common

BUCKETS, GRAM = 10_000, 3
#: Documents of fewer words are not drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text whose lines are told apart together.
SLICE_BYTES = 4_000_000
#: Different words after which a worker forgets their checksums.
KEPT_WORDS = 300_000
#: Lengths for which the shift of a checksum is tabulated; longer ones take several steps.
SHIFTS = 256

#: Bytes of words stay (A-Z lowered), newlines stay, all others become spaces.
_BYTES = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x == 0x0A else 0x20 for x in range(256))


def _shift_tables() -> np.ndarray:
    """[n, k, v]: what a checksum with byte v at place k becomes when n bytes follow."""
    step = np.array([zlib.crc32(b"\0", v ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)], np.uint32)
    table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    tables = [table]
    for _ in range(SHIFTS):
        table = (table >> np.uint32(8)) ^ step[table & np.uint32(0xFF)]
        tables.append(table)
    return np.stack(tables)


_tables = _shift_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums (CRC-32) of texts as their part in that of a text which goes on for ``n`` bytes."""
    crc, n = crc.copy(), n.copy()
    while len(rest := np.flatnonzero(n)):
        c, step = crc[rest], np.minimum(n[rest], SHIFTS)
        crc[rest] = _tables[step, 0, c & 0xFF] ^ _tables[step, 1, c >> 8 & 0xFF] ^ _tables[step, 2, c >> 16 & 0xFF] ^ _tables[step, 3, c >> 24]
        n[rest] -= step
    return crc


class _Words(dict):
    """Places of words in arrays of their checksum, that of the word behind a space, and its bytes
    with the space."""

    def __init__(self):
        self.held = np.zeros((3, 1024), np.int64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == self.held.shape[1]:
            self.held = np.concatenate([self.held, np.zeros_like(self.held)], 1)
        self.held[:, at] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        self[word] = at
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The three arrays for ``words``."""
        if len(self) > KEPT_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        one, spaced, size = self.held[:, at]
        return one.astype(np.uint32), spaced.astype(np.uint32), size


_words = _Words()


def gram_buckets(words: list[bytes], unit: np.ndarray, line: np.ndarray | None = None, gram: int = GRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of runs of 1 to ``gram`` consecutive words of one unit (its numbers ascend), and the units.
    With ``line``: only runs over more than one line of a unit."""
    one, spaced, size = _words.of(words)
    last = np.arange(len(words))
    crc, found, units = one, [], []
    for k in range(gram):
        if k:
            keep = last >= k
            crc, last = crc[keep], last[keep]
            keep = unit[last] == unit[last - k]
            # runs that end one word earlier stand one place before, if they lie in this unit
            crc, last = previous[last[keep] - 1], last[keep]
            crc = shifted(crc, size[last]) ^ spaced[last]
        previous = np.zeros(len(words), np.uint32)
        previous[last] = crc
        take = slice(None) if line is None else line[last] != line[last - k]
        found.append(crc[take] % np.uint32(buckets))
        units.append(unit[last][take])
    return np.concatenate(found).astype(np.int64), np.concatenate(units)


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Place of the first and bytes of some texts at a time."""
    held, size, first = [], 0, 0
    for k, raw in enumerate(column.cast(pa.binary()).to_pylist()):
        held.append(raw or b"")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def _lines(docs: DataFrame) -> DataFrame:
    """digest, line, n: the distinct lines that are not empty and how often they occur. Equal lines of
    some texts fall together before the shuffle, so a line of every document is one row of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch.column("text")):
                n: dict[bytes, int] = {}
                for raw in texts:
                    for line in raw.split(b"\n"):
                        if line:
                            n[line] = n.get(line, 0) + 1
                yield pa.record_batch({"digest": pa.array([hashlib.md5(x).digest() for x in n], pa.binary()), "line": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

    found = docs.select("text").mapInArrow(run, "digest binary, line binary, n long")
    return found.groupBy("digest", "line").agg(F.sum("n").alias("n"))


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_words, crossings (buckets of n-grams over newlines), and the
    digests of the lines with how often each occurs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column("text")):
                n_words, keys, digests, times, words, unit, line, lines = [], [], [], [], [], [], [], 0
                for k, raw in enumerate(texts):
                    total = 0
                    for part in raw.translate(_BYTES).split(b"\n"):
                        inside = part.split()
                        total += len(inside)
                        # two words at either end: runs over a newline reach no further
                        edge = inside if len(inside) <= 2 * (GRAM - 1) else inside[: GRAM - 1] + inside[1 - GRAM :]
                        words += edge
                        unit += [k] * len(edge)
                        line += [lines] * len(edge)
                        lines += 1
                    n: dict[bytes, int] = {}
                    for part in raw.split(b"\n"):
                        if part:
                            n[part] = n.get(part, 0) + 1
                    n_words.append(total)
                    keys.append(xxhash.xxh3_64_intdigest(raw) - 2**63)
                    digests.append([hashlib.md5(x).digest() for x in n])
                    times.append(list(n.values()))
                bucket, of = gram_buckets(words, np.array(unit, np.int64), np.array(line, np.int64))
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], np.arange(len(texts) + 1))
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(first, len(texts)), "key": pa.array(keys, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                    "crossings": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket[order], pa.int32())),
                    "digests": pa.array(digests, pa.list_(pa.binary())), "times": pa.array(times, pa.list_(pa.int64())),
                })

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, n_words long, crossings array<int>, digests array<binary>, times array<long>")


def _line_words(lines: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    words, sizes = [], []
    for raw in lines:
        inside = raw.translate(_BYTES).split()
        words += inside
        sizes.append(len(inside))
    return words, np.repeat(np.arange(len(lines)), sizes)


def _counts(lines: DataFrame, rows: DataFrame) -> np.ndarray:
    """Number of n-grams in each bucket: a distinct line's times its occurrences, and those over newlines.
    A task adds up its own, so what is moved are as many rows as buckets from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            for first, some in _slices(batch.column("line")):
                words, unit = _line_words(some)
                bucket, of = gram_buckets(words, unit)
                total += np.bincount(bucket, n[first + of], BUCKETS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    crossing = rows.select(F.explode("crossings").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    both = lines.select("line", "n").mapInArrow(run, "bucket int, n long").unionByName(crossing)
    out = np.zeros(BUCKETS, np.int64)
    for r in both.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(given: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in what is given), by bucket."""
    all_given, all_target = float(given.sum() + len(given)), float(target.sum() + len(target))
    shares = ((t + 1.0) * all_given / ((s + 1.0) * all_target) for s, t in zip(given.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in shares], np.int64)


def _weighed(lines: DataFrame, rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, key, n_words, weight, times of each different (doc_id, text); ``times``: rows alike."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            for first, some in _slices(batch.column("line")):
                words, unit = _line_words(some)
                bucket, of = gram_buckets(words, unit)
                total[first : first + len(some)] = np.bincount(of, gain[bucket], len(some)).astype(np.int64)
            yield pa.record_batch({"digest": batch.column("digest"), "weight": pa.array(total)})

    def of_crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("crossings")
            of = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            total = np.bincount(of, gain[column.flatten().to_numpy(zero_copy_only=False)], batch.num_rows).astype(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_words": batch.column("n_words"), "weight": pa.array(total)})

    own = rows.select("doc_id", "key", "n_words", "crossings").mapInArrow(of_crossings, f"doc_id {kind}, key long, n_words long, weight long").withColumn("rows", F.lit(1).cast("long"))
    held = rows.select("doc_id", "key", F.explode(F.arrays_zip("digests", "times")).alias("l")).select("doc_id", "key", F.col("l.digests").alias("digest"), F.col("l.times").alias("occurs"))
    weights = lines.select("digest", "line").mapInArrow(of_lines, "digest binary, weight long")
    inside = held.join(weights, "digest").select("doc_id", "key", F.lit(None).cast("long").alias("n_words"), (F.col("weight") * F.col("occurs")).alias("weight"), F.lit(0).cast("long").alias("rows"))
    both = own.unionByName(inside).groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"), F.sum("rows").alias("times"))
    return both.withColumn("weight", F.expr("weight div times"))


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank``, their place in ``order``: ranges are sorted by themselves, and the rows of
    the ranges before, one number each, are added."""
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    placed = common.stored(placed.select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")).drop("at"), "ranked")
    before, sizes = 0, []
    for r in placed.groupBy("range").agg((F.max("place") + 1).alias("n")).orderBy("range").collect():
        sizes.append((r.range, before))
        before += r.n
    offsets = rows.sparkSession.createDataFrame(sizes, "range long, before long")
    return placed.join(F.broadcast(offsets), "range").withColumn("rank", F.col("before") + F.col("place") + 1).drop("range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, key, n_words, n_features, weight, score, rank of every row of ``docs`` (doc_id, text) for
    the texts of ``target`` (text); ``key`` is a hash of the text.

    ``rank`` numbers the drawn rows from the highest score on; it is null for the others. Ties go to
    the smaller doc_id (null last), then to the smaller key; rows alike in both are told apart at
    random. Null and empty texts have no features and weight 0; a null id counts as an empty string
    in the random part of the score; repeated rows have rows of their own; other columns are ignored.
    An empty table gives an empty result, an empty target weights of the given texts alone. Whole
    texts and lines of any length are used. Lines are told apart by 128-bit digests.
    """
    counted = []
    for name, table in (("given", docs), ("target", target.select(F.lit(None).cast("long").alias("doc_id"), "text"))):
        lines = common.stored(_lines(table), f"{name}-lines")
        rows = common.stored(_documents(table), f"{name}-rows")
        counted.append((lines, rows, _counts(lines, rows)))
    (lines, rows, given), (_, _, wanted) = counted
    found = _weighed(lines, rows, gains(given, wanted))
    w = F.col("n_words")
    features = w + F.greatest(w - 1, F.lit(0)) + F.greatest(w - 2, F.lit(0))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    chance = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = found.withColumn("n_features", features.cast("long")).withColumn("score", F.col("weight") + chance)
    scored = common.stored(scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times"), "scores")
    eligible = F.col("n_words") >= least_words
    some = scored.filter(eligible).count() * percent // 100
    placed = _numbered(scored.filter(eligible), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key"), F.asc("copy"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= some, F.col("rank")))
    rest = scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "key", "n_words", "n_features", "weight", "score", "rank")
