"""SimHash document fingerprints and permuted block tables, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrid.functions.text import let
from billgrid.llm import common

BITS, SHINGLE, RADIUS, BLOCKS = 64, 5, 3, 6
#: Boundaries looked up per row; beyond that many parts each range is cut evenly.
_RANGES = 256
_LOW = -(2**63)


def terms(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles of ``text``, repeats included: a term's weight is how often it
    occurs. Fewer words are one term; so is a text without words."""
    words = F.array_remove(F.split(F.lower(text), common.SPACE_CLASS + "+"), "")

    def shingles(w: Column) -> Column:
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) < size, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))))

    return let(words, shingles)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` (long) of every distinct value of ``keys``.

    Each term hash votes on every bit, +1 if the bit is set and -1 if not. Votes are sums of
    one row per term; two bits share a long, 32 bits each. Sums run before the shuffle, so one row
    for each text and task is shuffled.
    """
    rows = texts.select(*keys, F.explode(terms(F.col(text))).alias("h"))
    lanes = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit(0x1_0000_0001))).alias(f"v{k}") for k in range(BITS // 2)]
    votes = rows.groupBy(*keys).agg(F.count("*").alias("n"), *lanes)
    bit = lambda set_, k: F.when(set_ * 2 > F.col("n"), F.lit(1 << k if k < 63 else _LOW).cast("long")).otherwise(F.lit(0).cast("long"))
    out = F.lit(0).cast("long")
    for k in range(BITS // 2):
        out = out.bitwiseOR(bit(F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), k)).bitwiseOR(bit(F.shiftright(f"v{k}", 32), k + 32))
    return votes.select(*keys, out.alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / float(BITS)


def as_hex(name: str) -> Column:
    return F.lower(F.lpad(F.hex(name), BITS // 4, "0"))


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bits of each table's key: every choice of ``blocks - radius`` blocks. Fingerprints within
    ``radius`` bits differ in at most so many blocks and agree on the others, so on some key."""
    ends = [BITS * k // blocks for k in range(blocks + 1)]
    of = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(ends, ends[1:])]
    return [x - 2**64 if x >= 2**63 else x for x in (sum(c) for c in combinations(of, blocks - radius))]


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint, near, distance: all of ``prints`` (distinct ``fingerprint``) within ``radius``
    bits of each of ``queries`` (distinct ``fingerprint``), itself included.

    A pair is formed in the first table whose key both share, and only if it is near enough.
    """
    masks = block_masks(radius, blocks)

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
        return df.select(F.col("fingerprint").alias(name), F.explode(keys).alias("e")).select(name, "e.t", "e.key")

    diff = F.col("fingerprint").bitwiseXOR(F.col("near"))
    first = F.lit(None)
    for t, m in reversed(list(enumerate(masks))):
        first = F.when(diff.bitwiseAND(F.lit(m)) == 0, t).otherwise(first)
    q, p = tables(queries, "fingerprint").alias("q"), tables(prints, "near").alias("p")
    on = (F.col("q.t") == F.col("p.t")) & (F.col("q.key") == F.col("p.key")) & (F.bit_count(diff) <= radius) & (F.col("q.t") == first)
    return q.join(p, on).select("fingerprint", "near", F.bit_count(diff).alias("distance"))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """bucket, row, doc_id, text, next_text: each row with the text of the next in ascending doc_id
    order (null ids first, ties by a hash of the text); the last row gets the first one's.

    Rows go to ranges of doc_id between quantiles, and the first row of each range is copied to the
    range before it, so that a window within the range sees it. Of the ranges only their first ids
    come to the driver: as many as there are parts.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", common.whole_text().alias("text")).withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)))
    ranges = min(parts, _RANGES)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / ranges for i in range(ranges + 1)], 100 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    sub = -(-parts // ranges)

    def place(lo: int, hi: int) -> Column:
        """Index of the range of k, by halves."""
        if hi - lo <= 1:
            width = max(1, -(-(cuts[lo + 1] - cuts[lo]) // sub)) if lo + 1 < len(cuts) else 1
            within = F.floor((F.col("k") - F.lit(cuts[lo])) / width) if sub > 1 and lo + 1 < len(cuts) else F.lit(0)
            return F.lit(lo * sub) + F.greatest(F.lit(0), F.least(F.lit(sub - 1), within)).cast("int")
        mid = (lo + hi) // 2
        return F.when(F.col("k") < F.lit(cuts[mid]), place(lo, mid)).otherwise(place(mid, hi))

    base = base.withColumn("bucket", F.when(F.col("k") < F.lit(cuts[0]), F.lit(-1)).otherwise(place(0, len(cuts))) if cuts else F.lit(-1))
    firsts = sorted((r.bucket, r.k) for r in base.groupBy("bucket").agg(F.min("k").alias("k")).collect())
    copies = [(b, k, firsts[i - 1][0]) for i, (b, k) in enumerate(firsts)]
    copies = spark.createDataFrame(copies, "bucket int, k long, into int")
    shown = base.join(F.broadcast(copies), ["bucket", "k"]).select("doc_id", "text", "k", F.col("into").alias("bucket"), F.lit(1).alias("copy"))
    rows = base.select("doc_id", "text", "k", "bucket", F.lit(0).alias("copy")).unionByName(shown)
    order = Window.partitionBy("bucket").orderBy("copy", "k", F.xxhash64("text"))
    rows = rows.select("bucket", F.row_number().over(order).alias("row"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "copy")
    return rows.filter("copy = 0").drop("copy")


def compare_edited(docs: DataFrame, every: int = 100, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of all texts and of their edited forms (last quarter replaced by the beginning
    of the next document's text), how like they are, and the number of near documents.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited,
    near_next, n_near: for rows whose id is divisible by ``every`` the number of other documents
    whose fingerprint is within ``radius`` bits, null for others.

    Null texts are empty; texts without words share one fingerprint; null ids come first and are not
    queries; repeated rows and ties give a row each, in the order of a hash of their text; an only
    row follows itself; an empty table gives an empty result; other columns are ignored.
    """
    rows = with_next(docs)
    n, q = F.col("n_chars"), F.floor(F.col("n_chars") / 4)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - q).cast("int")), F.substring("next_text", F.lit(1), q.cast("int"))))
    same = lambda c: F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), c))
    keys = ["bucket", "row", "doc_id", "n_chars", "edited_sha256", "this", "next"]
    both = rows.select("bucket", "row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), same("text").alias("this"), same("next_text").alias("next"),
                       F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("e"))
    prints = fingerprints(both.select(*keys, "e.kind", "e.body"), [*keys, "kind"], "body")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("fingerprint")))
    prints = common.stored(prints.groupBy(*keys).agg(of(0).alias("fp"), of(1).alias("edited_fp")), "fingerprints")
    by_text = prints.groupBy("this").agg(F.max("fp").alias("next_fp")).withColumnRenamed("this", "next")
    counted = prints.groupBy(F.col("fp").alias("fingerprint")).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("doc_id") % every == 0, F.lit(False))).alias("asked"))
    counted = common.stored(counted, "fingerprint-counts")
    near = neighbours(counted.filter("asked").select("fingerprint"), counted.select("fingerprint"), radius)
    near = near.join(counted.select(F.col("fingerprint").alias("near"), "n"), "near").groupBy("fingerprint").agg((F.sum("n") - 1).alias("n_near"))
    out = prints.join(by_text, "next", "left").join(near.withColumnRenamed("fingerprint", "fp"), "fp", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"),
                      likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
                      F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"))
