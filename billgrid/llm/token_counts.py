"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer version, content digest, count). Texts meet it by
digest; each distinct text that it lacks is encoded once and appended.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid.llm import common

CACHE = "digest binary, n_tokens long, version string"
#: Characters handed to the library in one call, and the length from which a text is cut.
CALL_CHARS, LONG_TEXT = 1_000_000, 200_000

_models: dict[str, tuple] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library that applies it."""
    kind = "tokenizers" if path.endswith(".json") else "sentencepiece"
    library = __import__(kind)
    return hashlib.sha256(Path(path).read_bytes() + f"{kind} {library.__version__}".encode()).hexdigest()


def _load(path: str):
    """(list of texts -> list of counts, whether a long text may be cut at single spaces)."""
    if path not in _models:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _models[path] = (lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]), False
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            # A cut drops one space and the next part gets it back as the prefix that the model
            # adds to any text. No token can span it if none has a space mark after another character.
            pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            safe = not any("▁" in p.lstrip("▁") for p in pieces) and all(
                sp.encode(x, out_type=str)[0].startswith("▁") for x in ("a", " a")) and len(sp.encode("a b  c ")) == len(sp.encode("a")) + len(sp.encode("b")) + len(sp.encode(" c "))
            _models[path] = (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), safe
    return _models[path]


_CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")


def pieces(text: str, longest: int) -> list[str]:
    """Parts of ``text`` of about ``longest`` characters, cut at single spaces, which go."""
    out, start = [], 0
    while len(text) - start > longest and (m := _CUT.search(text, start + longest)):
        out.append(text[start : m.start()])
        start = m.end()
    return [*out, text[start:]]


def count_texts(texts: list[str], path: str, longest: int = LONG_TEXT) -> list[int]:
    """Tokens of each text as the library counts them."""
    count, safe = _load(path)
    owner, parts, size, counts = [], [], 0, [0] * len(texts)

    def flush() -> None:
        for k, n in zip(owner, count(parts)) if parts else ():
            counts[k] += n

    for k, text in enumerate(texts):
        for part in pieces(text, longest) if safe and len(text) > longest else [text]:
            owner.append(k)
            parts.append(part)
            size += len(part)
            if size >= CALL_CHARS:
                flush()
                owner, parts, size = [], [], 0
    flush()
    return counts


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts that ``cache`` holds for one tokenizer; an absent cache is empty."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    held = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # runs at the same time may both have added a text


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    Normalised content is the text with null as empty: nothing else leaves every count as the
    library gives it. Rows keep their number, order none; repeated rows, null ids and ties give a
    row each; empty texts have 0 bytes; an empty table gives an empty result; other columns are
    ignored. Texts of any length are counted whole: where the vocabulary allows it, beyond
    ``LONG_TEXT`` characters in parts that no token can span. ``cache`` is a folder that all
    executors share. A job that fails leaves the cache as it was, since appends are committed whole.
    """
    version = tokenizer_version(tokenizer)
    base = docs.select("doc_id", common.whole_text().alias("text"))
    keyed = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # copies of a text fall together before the shuffle, so a text in a third of all rows is one row of each task
    distinct = base.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"))
    missing = distinct.join(read_cache(docs.sparkSession, cache, version), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(common.strings(batch.column("text")), tokenizer)
            yield pa.record_batch({"digest": batch.column("digest"), "n_tokens": pa.array(counts, pa.int64())})

    added = missing.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")
    added.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    counts = read_cache(docs.sparkSession, cache, version)
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
