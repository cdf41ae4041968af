import hashlib
import json
import random

import public_tokenizers as vocabularies
import pytest
from tokenizers import Tokenizer

from billgrid.llm import word_bpe

PATH = vocabularies.path("word_bpe_49k.json")


def _library(text):
    t = Tokenizer.from_file(PATH)
    ids = t.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_equals_the_library(odd, odd_rows, none):
    got = word_bpe.round_trip(odd, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((repr(r.doc_id), *r[1:]) for r in got.collect()) == sorted((repr(i), *_library(t or "")) for i, t, *_ in odd_rows)
    assert word_bpe.round_trip(none, PATH).count() == 0


def test_special_strings_and_odd_characters_equal_the_library():
    bpe, t = word_bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = ["a<|endoftext|>b<|startoftext|> x<|endoftext", "<|endoftext|>", "x<|startoftext|>", "they'll DON'T 'S 's", "ΣΑΣ ǅ İ ß", "Ünï", "　a b\x85c\x1cd", "a" * 5000, "aA" * 2000 + "!" * 900, "́x ﻿​ 𝔘"]
    texts += ["".join(rng.choice("aabbétÉσ日'sSrR012٣!?<|> ́̈") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for letters in ("ab", "etaoinshr", "el") for _ in range(400)]
    chunks = [x.encode().split() for x in texts]
    ids = bpe.chunk_ids({c for x in chunks for c in x})
    for text, cut in zip(texts, chunks):
        assert [i for c in cut for i in ids[c]] == t.encode(text, add_special_tokens=False).ids, text


def test_every_token_of_the_vocabulary_at_the_seam_of_two_words():
    """Words made of two tokens each meet every rule about tokens that stay apart."""
    bpe, t = word_bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    plain = [x for x in bpe._inner if x.isascii() and x.isalpha() and x.islower()]
    words = {rng.choice(plain) + rng.choice(plain) + rng.choice(("", rng.choice(plain))) for _ in range(4000)}
    ids = bpe.encode_words(words)
    assert all(ids[w] == t.encode(w, add_special_tokens=False).ids for w in words)


def test_kept_chunks_stay_bounded_and_right(monkeypatch):
    monkeypatch.setattr(word_bpe, "KEPT_CHUNKS", 3)
    bpe = word_bpe.WordBpe(PATH)
    for words in (["one", "two"], ["three", "four", "five"], ["one", "six"], ["seven", "two"], ["one", "two", "eight"]):
        for chunk, (n, ids, _) in bpe.written({w.encode() for w in words}).items():
            assert list(map(int, ids.split())) == bpe.chunk_ids([chunk])[chunk] and n == len(ids.split())
        assert len(bpe._young) + len(bpe._old) <= 12


def test_encode_then_decode(odd, odd_rows):
    t = Tokenizer.from_file(PATH)
    ids = {r.doc_id: r.ids for r in word_bpe.encode(odd, PATH).collect()}
    assert all(ids[i] == t.encode(x or "", add_special_tokens=False).ids for i, x, *_ in odd_rows if i is not None and i != 103)
    back = {r.doc_id: r.text for r in word_bpe.decode(word_bpe.encode(odd, PATH), PATH).collect()}
    assert all(back[i] == t.decode(ids[i], skip_special_tokens=False) for i in ids if i is not None)


def test_another_kind_of_vocabulary_is_refused(tmp_path):
    with pytest.raises(ValueError):
        word_bpe.WordBpe(vocabularies.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]  # tokens before their parts
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        word_bpe.WordBpe(str(tmp_path / "v.json"))
