"""BPE with word ends: distinct words are encoded along a trie, so that a shared prefix is encoded once.

The encoding of a prefix is that of a shorter prefix and one more token, its last. Two neighbours in
an encoding are two tokens that stay apart when their joined text is encoded, and any sequence of
such neighbours is an encoding. So a node of the trie needs only the last token of its prefix: the
one token ending there that can stand behind the last token of the node where it begins.
"""

from __future__ import annotations

import gc
import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from billgrid.llm import common

#: Bytes of text whose distinct words are encoded together.
SLICE_BYTES = 8_000_000
#: Chunks between white space after which a worker drops those that it has not met again (it holds
#: twice as many at most), and their longest length in bytes.
KEPT_CHUNKS, KEPT_BYTES = 300_000, 40
#: Pairs of tokens that a worker remembers.
KEPT_PAIRS = 1_000_000

_NEVER = math.inf
_models: dict[str, "WordBpe"] = {}


class WordBpe:
    """A BPE vocabulary of ordered merges whose last symbol of a word is marked by a suffix.

    The file's own normalizer and splitter are the library's; the merges are applied here. Raises
    ValueError for a vocabulary to which the walk over a trie doesn't apply.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model, added = spec["model"], spec["added_tokens"]
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] and spec["decoder"] is None and not any(model[x] for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or not x["content"].strip() or x["content"].encode().split() != [x["content"].encode()] for x in added):
            raise ValueError(f"{path}: not a vocabulary of merges with word ends")
        self._library = Tokenizer.from_file(path)
        self._special = {x["content"]: x["id"] for x in added}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if added else None
        self.text = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self._special.items()}
        self._decimal, self._bytes = {i: str(i).encode() for i in self.text}, {i: t.encode() for i, t in self.text.items()}
        #: how printable ASCII, which other normalizations leave alone, is split; unknown steps are the library's
        self._plain = None
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())], [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
        if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            split, level = spec["pre_tokenizer"]["pretokenizers"]
            if spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and split["behavior"] == "Removed" and split["invert"] and not (level["add_prefix_space"] or level["use_regex"]):
                self._plain = regex.compile(split["pattern"]["Regex"])
        suffix, ids = model["end_of_word_suffix"], model["vocab"]
        #: (left, right, rank) of each merged token, and the rank of each pair
        self._parts: dict[int, tuple[int, int, int]] = {}
        self._rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (ids[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = ids[self.text[left] + self.text[right]]
            if whole in self._parts or any(len(self.text[x].removesuffix(suffix)) > 1 and x not in self._parts for x in (left, right)):
                raise ValueError(f"{path}: merge {rank} makes a token anew or from one not made before")
            self._parts[whole], self._rank[left, right] = (left, right, rank), rank
        #: tokens inside a word and at its end, by their text
        self._inner: dict[str, int] = {}
        self._ending: dict[str, int] = {}
        self._size: dict[int, int] = {}
        for t, i in ids.items():
            last = i
            while last in self._parts:
                last = self._parts[last][1]
            ends = len(self.text[last]) > len(suffix) and self.text[last].endswith(suffix)
            bare = t[: -len(suffix)] if ends else t
            (self._ending if ends else self._inner)[bare] = i
            self._size[i] = len(bare)
        self._edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._apart: dict[int, bool] = {}
        for table in (self._inner, self._ending):
            for text in [x for x, i in table.items() if not self._is_sound(i)]:
                del table[text]
        #: longest token that ends with three symbols
        self._reach: list[dict[str, int]] = []
        for table in (self._inner, self._ending):
            reach: dict[str, int] = {}
            for text in table:
                if len(text) > 2:
                    reach[text[-3:]] = max(len(text), reach.get(text[-3:], 0))
            self._reach.append(reach)
        self._young: dict[bytes, tuple[int, bytes, bytes]] = {}
        self._old: dict[bytes, tuple[int, bytes, bytes]] = {}
        for text in ("It's a  test,\n\n don't  3\t45 Ünï x", *self._special):
            if [i for x in text.encode().split() for i in self.chunk_ids([x])[x]] != self._library.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{path}: the library doesn't cut texts at white space")

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge of ``token`` (0: first, 1: last) while its symbols are merged,
        each with the rank of the merge that takes it."""
        if (token, side) not in self._edges:
            inside = self._parts.get(token)
            if inside is None:
                found = [(token, _NEVER)]
            else:
                below = self._edge(inside[side], side)
                found = [*below[:-1], (below[-1][0], inside[2]), (token, _NEVER)]
            self._edges[token, side] = found
        return self._edges[token, side]

    def _meeting(self, a: int, b: int) -> tuple[float, bool]:
        """Rank of the merge across the seam of ``a`` and ``b`` (never: they stay apart), and whether
        both are whole by then. Merges run by rank, equal ones from the left."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, takes_x), (y, takes_y) = left[i], right[j]
            seam = self._rank.get((x, y), _NEVER)
            if (seam < takes_x and seam <= takes_y) or takes_x == takes_y == _NEVER:
                return seam, takes_x == takes_y == _NEVER
            if takes_x <= takes_y:
                i += 1
            else:
                j += 1

    def _stay_apart(self, a: int, b: int) -> bool:
        return self._meeting(a, b)[0] == _NEVER

    def _is_sound(self, token: int) -> bool:
        """Whether the text of ``token`` is encoded as ``token``."""
        inside = self._parts.get(token)
        return inside is None or self._meeting(*inside[:2]) == (inside[2], True)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word (not empty, its bytes written as the vocabulary's symbols).

        Sorted words are the trie's depth-first order: what a word shares with the one before it is the
        path that stays, and ``lasts[d]`` is the last token of the path's first d symbols.
        """
        found: dict[str, list[int]] = {}
        size, apart, (inside, last) = self._size, self._apart, zip((self._inner, self._ending), self._reach)
        before, lasts = "", [-1]
        for word in sorted(words):
            end = len(word)
            depth, most = 0, min(len(before), end) - 1
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del lasts[depth + 1 :]
            while depth < end:
                depth += 1
                table, reach = inside if depth < end else last
                for at in range(max(0, depth - reach.get(word[depth - 3 : depth], 2)) if depth > 2 else 0, depth):
                    token = table.get(word[at:depth])
                    if token is None:
                        continue
                    if not at:
                        break
                    pair = lasts[at] << 32 | token
                    keeps = apart.get(pair)
                    if keeps is None:
                        if len(apart) > KEPT_PAIRS:
                            apart.clear()
                        keeps = apart[pair] = self._stay_apart(lasts[at], token)
                    if keeps:
                        break
                else:
                    raise ValueError(f"no token for {word[depth - 1]!r}")
                lasts.append(token)
            ids = [lasts.pop()]
            at = end - size[ids[0]]
            while at:
                ids.append(lasts[at])
                at -= size[lasts[at]]
            ids.reverse()
            found[word], before = ids, word
        return found

    def _split(self, chunks: Iterable[bytes]) -> dict[bytes, list[int | str]]:
        """Special tokens (ids) and words (text) of what stands between white space. Parts without white
        space of their own go to the library's splitter together, one space apart."""
        out: dict[bytes, list[int | str]] = {}
        owners, parts = [], []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            if self._plain is not None and text.isascii() and text.isprintable() and not (self._cut and self._cut.search(text)):
                out[chunk] = self._plain.findall(text.lower())
                continue
            found = out[chunk] = []
            for part in self._cut.split(text) if self._cut and self._cut.search(text) else (text,):
                if part in self._special:
                    found.append(self._special[part])
                elif part:
                    part = self._library.normalizer.normalize_str(part)
                    if len(found) or " " in part:  # behind another part, or cut once more
                        found += [word for word, _ in self._library.pre_tokenizer.pre_tokenize_str(part) if word]
                    else:
                        owners.append(found)
                        parts.append(part)
                        found.append("")  # its place
        words: list[list[str]] = [[] for _ in parts]
        ends, at, k = [], -1, 0
        for part in parts:
            at += len(part) + 1
            ends.append(at)
        for word, (start, _) in self._library.pre_tokenizer.pre_tokenize_str(" ".join(parts)):
            while start >= ends[k]:
                k += 1
            words[k].append(word)
        for found, inside in zip(owners, words):
            found[:1] = inside
        return out

    def chunk_ids(self, chunks: Iterable[bytes]) -> dict[bytes, list[int]]:
        split = self._split(chunks)
        ids = self.encode_words({w for words in split.values() for w in words if isinstance(w, str)})
        return {chunk: [i for w in words for i in (ids[w] if isinstance(w, str) else (w,))] for chunk, words in split.items()}

    def written(self, chunks: set[bytes]) -> dict[bytes, tuple[int, bytes, bytes]]:
        """Number of tokens, ids and tokens (joined by one space) of each chunk."""
        if len(self._young) > KEPT_CHUNKS:  # what was not met since the last time goes
            self._old, self._young = self._young, {}
        found = {}
        for x in chunks:
            known = self._young.get(x)
            if known is None and (known := self._old.get(x)) is not None:
                self._young[x] = known
            if known is not None:
                found[x] = known
        for chunk, ids in self.chunk_ids(chunks - found.keys()).items():
            found[chunk] = len(ids), b" ".join([self._decimal[i] for i in ids]), b" ".join([self._bytes[i] for i in ids])
            if len(chunk) <= KEPT_BYTES:
                self._young[chunk] = found[chunk]
        return found


def vocabulary(path: str) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
        # millions of small objects without cycles come and go here: looking for cycles takes a fifth of the time
        gc.freeze()
        gc.set_threshold(1_000_000, 50, 1_000)
    return _models[path]


def _slices(column: pa.Array, most: int) -> Iterator[list[list[bytes]]]:
    """The chunks between ASCII white space of each text, for about ``most`` bytes of texts at a time.
    No token and no normalization reaches over white space."""
    held, size = [], 0
    for raw in column.cast(pa.binary()).to_pylist():
        held.append((raw or b"").split())
        size += len(raw or b"") + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; texts as in ``round_trip``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text"), SLICE_BYTES):
                ids = bpe.chunk_ids({x for text in texts for x in text})
                out = [[i for x in text for i in ids[x]] for text in texts]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(at, len(texts)), "ids": pa.array(out, pa.list_(pa.int32()))})
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of every row of (doc_id, ids): the tokens joined by a space, as the library
    gives them without a decoder. Null ids give null; unknown ids give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            out = [None if x is None else " ".join(bpe.text[i] for i in x if i in bpe.text) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 of every row of
    ``docs`` (doc_id, text).

    One pass without a shuffle: a task encodes the distinct words of ``SLICE_BYTES`` of text along one
    trie and keeps the short ones for the texts to come, in memory of a fixed bound. Null and empty
    texts have no tokens and the digests of nothing; special strings inside texts are the special
    tokens, as by the library's default; repeated rows, ties and null ids give a row each; an empty
    table gives an empty result; other columns are ignored. Texts and words of any length are whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text"), SLICE_BYTES):
                known = bpe.written({x for text in texts for x in text})
                n, ids, decoded = [], [], []
                for text in texts:
                    rows = [x for x in map(known.__getitem__, text) if x[0]]
                    n.append(sum(x[0] for x in rows))
                    ids.append(hashlib.sha256(b" ".join([x[1] for x in rows])).hexdigest())
                    decoded.append(hashlib.sha256(b" ".join([x[2] for x in rows])).hexdigest())
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(at, len(texts)), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
