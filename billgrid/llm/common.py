"""Helpers that several operators share: whole texts, words, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid.session import work_dir

#: Characters that separate words: space, and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared working folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: cuts lineage."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> list[str | None]:
    """Python strings; bytes that are not UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def word_list(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lowered: bytes know no case and no white space but ASCII's."""
    return raw.lower().split()


class WordHashes(dict):
    """64-bit hash of each word, computed once while the table is small enough to keep."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def complete_groups(batches, columns: tuple[str, ...], keys: tuple[str, ...]):
    """Chunks of columns as numpy arrays that end where a group ends; rows come sorted by ``keys``."""
    held: list[dict[str, np.ndarray]] = []  # pieces of the group that is not yet complete
    whole = lambda: {c: np.concatenate([x[c] for x in held]) for c in columns}
    for batch in batches:
        if batch.num_rows:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            other = np.flatnonzero(np.any([new[c] != new[c][-1] for c in keys], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or any(held[-1][c][-1] != new[c][-1] for c in keys)):
                held.append({c: x[:cut] for c, x in new.items()})
                yield whole()
                held = []
            elif cut:
                yield {c: x[:cut] for c, x in new.items()}
            held.append({c: x[cut:] for c, x in new.items()})
    if held:
        yield whole()


def components(links: DataFrame, name: str, most: int = 60) -> DataFrame:
    """``id`` and ``component_id`` (smallest id reachable) of every id in ``links`` (columns a, b).

    Alternating large-star and small-star steps: both are joins with a minimum per id, so no
    neighbourhood is gathered, and every step keeps the number of links or lowers it. The links
    are stored after each round; rounds grow with the logarithm of the longest path.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
        edges = stored(small, name)
        seen = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)), F.count_distinct("a")).first()
        if tuple(seen) == before and seen[0] == seen[2]:
            roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
        before = tuple(seen)
    raise RuntimeError(f"links did not settle in {most} rounds")
