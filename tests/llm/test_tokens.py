import base64
import hashlib

import public_tokenizers as vocabularies
import sentencepiece
import tiktoken

from billgrid.llm import byte_bpe, token_counts

MODEL, RANKS = vocabularies.path("piece_bpe_32k.model"), vocabularies.path("byte_bpe_multi_50k.tiktoken")


def test_counts_equal_the_library(spark, odd, odd_rows, none, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(odd, MODEL, cache)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((repr(i), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in odd_rows)
    assert sorted((repr(r.doc_id), *r[1:]) for r in got.collect()) == want
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == len({t or "" for _, t, *_ in odd_rows})
    again = token_counts.count_tokens(odd, MODEL, cache)  # all hits: nothing is added
    assert sorted((repr(r.doc_id), *r[1:]) for r in again.collect()) == want
    assert spark.read.parquet(cache).count() == held.count()
    assert token_counts.count_tokens(none, MODEL, str(tmp_path / "none")).count() == 0


def test_another_tokenizer_has_counts_of_its_own(odd, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    cache = str(tmp_path / "cache")
    token_counts.count_tokens(odd, MODEL, cache).count()
    got = token_counts.count_tokens(odd, vocabularies.path("word_bpe_49k.json"), cache)
    want = sorted((repr(i), len(t.encode(x or "", add_special_tokens=False))) for i, x, *_ in odd_rows)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in got.collect()) == want


def test_long_texts_are_cut_without_changing_counts():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("a b  c\n d   e f" * 50, " lead and  trail ", "x" * 300, "<s> a </s> <unk> b <0x41> c" * 20, "é " * 100, "　a ▁b c " * 30):
        assert token_counts.count_texts([text], MODEL, longest=7) == [len(sp.encode(text))], text[:20]


def _bpe():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(odd, odd_rows, none):
    bpe = _bpe()
    want = []
    for i, t, *_ in odd_rows:
        ids = bpe.encode_ordinary(t or "")
        want.append((repr(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.round_trip(odd, RANKS, vocabularies.PATTERN)
    assert sorted((repr(r.doc_id), *r[1:]) for r in got.collect()) == sorted(want)
    assert byte_bpe.round_trip(none, RANKS, vocabularies.PATTERN).count() == 0


def test_safe_parts_keep_the_ids():
    bpe = _bpe()
    for text in ("it's  a \n\n test12ab, they'll 'sabc!?  ", "don't stop  \t now" * 9, "'s't're" * 20, "日本語 テキスト 123４５" * 9, "     ", "a" * 50 + "1" * 50 + "!" * 50, "x  y  z"):
        for longest in (1, 3, 10):
            ids = [i for part in byte_bpe.safe_parts(text, longest) for i in bpe.encode_ordinary(part)]
            assert ids == bpe.encode_ordinary(text), (text, longest)


def test_encode_then_decode_gives_the_bytes(odd, odd_rows):
    back = byte_bpe.decode(byte_bpe.encode(odd, RANKS, vocabularies.PATTERN), RANKS, vocabularies.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in odd_rows)
