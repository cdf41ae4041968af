"""Byte-level BPE encoding and decoding by a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from billgrid.llm import common

#: Length from which a text is cut at safe boundaries before it is encoded.
LONG_TEXT = 100_000

_encodings: dict[tuple[str, str], object] = {}
#: The split pattern never matches across these places: before white space after anything else, and
#: after a letter or number before anything of another class. What it matches on either side does
#: not depend on the other, since its only look-ahead concerns white space that more text follows.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


def encoding(ranks: str, pattern: str):
    """The library's encoding for a rank file (lines of a base64 token and its rank)."""
    if (ranks, pattern) not in _encodings:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[ranks, pattern]


def safe_parts(text: str, longest: int = LONG_TEXT) -> Iterator[str]:
    """Parts of about ``longest`` characters; only a single run of one character class is longer."""
    start = 0
    while len(text) - start > longest and (m := _SAFE.search(text, start + longest)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_and_decode(text: str, ranks: str, pattern: str, longest: int = LONG_TEXT) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids (decimal, comma-joined) and of the bytes they decode to."""
    bpe, n, ids_sha, decoded_sha = encoding(ranks, pattern), 0, hashlib.sha256(), hashlib.sha256()
    for part in safe_parts(text, longest):
        ids = bpe.encode_ordinary(part)
        ids_sha.update((b"," if n and ids else b"") + ",".join(map(str, ids)).encode())
        decoded_sha.update(bpe.decode_bytes(ids))
        n += len(ids)
    return n, ids_sha.hexdigest(), decoded_sha.hexdigest()


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; texts as in ``round_trip``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks, pattern)
        for batch in batches:
            ids = [[i for part in safe_parts(x or "") for i in bpe.encode_ordinary(part)] for x in common.strings(batch.column("text"))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ``bytes`` of every row of (doc_id, ids): raw bytes, as a part of a text need not
    be UTF-8. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks, pattern)
        for batch in batches:
            out = [None if x is None else bpe.decode_bytes(x) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "bytes": pa.array(out, pa.binary())})

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text).

    One pass without a shuffle. Null and empty texts have no tokens and the digests of nothing;
    repeated rows, ties and null ids give a row each; an empty table gives an empty result; other
    columns are ignored. Texts of any length are encoded whole, in parts of ``LONG_TEXT``
    characters whose ids are digested part by part, so memory does not grow with a text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode_and_decode(x or "", ranks, pattern) for x in common.strings(batch.column("text"))]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
