import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from billgrid.llm import katz, language_id, licenses, mixing, pii, simhash
from llm_rows import DOCS, sentences


def _katz(rows, trained):
    """The same model, token by token."""
    toks = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    uni, pairs, ctx = Counter(), Counter(), Counter()
    for w, train in zip(toks, trained):
        if train:
            before = ["<s>", *w[:-1]]
            uni.update(w)
            pairs.update(zip(before, w))
            ctx.update(before)
    n, v = sum(uni.values()), len(uni)
    small = lambda c: np.bincount(np.minimum([*c.values(), 12], 12), minlength=13)[:12]
    dp, dw = katz.Discounts.of(small(pairs)), katz.Discounts.of(small(uni))
    u = {w: float(dw(np.array(c))) / n for w, c in uni.items()}
    unknown = 1 - sum(u.values())
    kept, lower = Counter(), Counter()
    for (a, b), c in pairs.items():
        kept[a] += float(dp(np.array(c)))
        lower[a] += u[b]
    alpha = {a: (1 - kept[a] / ctx[a]) / (1 - lower[a]) for a in ctx}
    p = lambda a, b: float(dp(np.array(pairs[a, b]))) / ctx[a] if (a, b) in pairs else alpha.get(a, 1.0) * u.get(b, unknown)
    for a in list(ctx)[:5]:  # chances after a context sum to 1
        assert abs(sum(p(a, b) for b in uni) + alpha[a] * unknown - 1) < 1e-9
    return sorted((repr(r[0]), not train, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w),
                   sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w))) for r, w, train in zip(rows, toks, trained))


@pytest.mark.parametrize("settings", [{}, {"LOCAL": 2, "SAMPLED": 2, "PAIR_SHARE": 50, "CHUNK": 500, "BUCKET": 2000, "FREQUENT": 12, "PAIRS": 7}])
def test_katz_equals_the_model_token_by_token(spark, odd, odd_rows, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(katz, name, value)
    kept = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    want = _katz(odd_rows, [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, *_ in odd_rows])
    got = sorted((repr(r[0]), *r[1:]) for r in katz.score(odd, kept).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_katz_without_training_or_rows(spark, odd, none):
    got = katz.score(odd, F.lit(False)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)
    assert katz.score(none, F.lit(True)).count() == 0


def test_license_scan(spark, odd, none):
    apache = "... Licensed under the Apache License, Version 2.0!"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    changed = gpl.replace("can redistribute", "may redistribute").replace("published by the", "issued by our")
    rows = [(1, sentences(1, 500) + "\n" + apache + "\n" + sentences(2, 300)), (2, gpl + " " + sentences(3, 40)), (3, sentences(4, 99) + " " + gpl.upper().replace(" ", " - ")),
            (4, changed), (5, "Licensed under the Apache"), (6, None), (7, ""), (8, gpl + " " + apache), (8, gpl + " " + apache), (None, "Released under the MIT License.")]
    got = sorted((repr(r.doc_id), r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("s", F.lit(1))).collect())
    assert got == [("1", "Apache-2.0"), ("2", "GPL"), ("3", "GPL"), ("4", ""), ("5", ""), ("6", ""), ("7", ""), ("8", "Apache-2.0,GPL"), ("8", "Apache-2.0,GPL"), ("None", "MIT")]
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == odd.count()
    assert licenses.scan(odd, []).filter("n_matches = 0").count() == odd.count()
    for similarity in (0.2, 1 / 3, 0.6):
        assert (1 - similarity) ** licenses.bands_needed(similarity, 1e-6) <= 1e-6


def test_simhash_of_edited_texts(spark, odd, odd_rows, none):
    got = simhash.compare_edited(odd).collect()
    rows = sorted([(-(2**63) if i is None else i, i, t or "") for i, t, *_ in odd_rows], key=lambda r: r[0])
    assert len(got) == len(rows)
    ties = {k for k, _, _ in rows if sum(x[0] == k for x in rows) > 1}
    by = {r.doc_id: r for r in got}
    for (k, i, t), (_, _, after) in zip(rows, rows[1:] + rows[:1]):
        if k in ties or rows[(rows.index((k, i, t)) + 1) % len(rows)][0] in ties:
            continue
        q = len(t) // 4
        assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest(), i
        assert by[i].n_chars == len(t)
    prints = {}
    for r in got:
        assert len(r.fingerprint) == 16 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == 1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / 64
        prints.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert len({r.fingerprint for r in got if r.doc_id in (3, 103)}) == 1  # equal texts
    assert by[20].n_near is None and by[100].n_near == sum(r.doc_id != 100 and (int(r.fingerprint, 16) ^ int(by[100].fingerprint, 16)).bit_count() <= 3 for r in got)
    assert simhash.compare_edited(none).count() == 0


def test_next_rows_over_many_ranges(spark):
    rng = random.Random(1)
    ids = rng.sample(range(-1000, 10**6), 400)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    for parts in (1, 7, 300, 700):
        got = {r.doc_id: r.next_text for r in simhash.with_next(df, parts).collect()}
        order = sorted(ids)
        assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_block_tables_find_all_near_fingerprints(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    some = base + [x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in base for k in (1, 2, 3, 4)]
    signed = [x - 2**64 if x >= 2**63 else x for x in dict.fromkeys(some)]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    got = sorted((r.fingerprint, r.near, r.distance) for r in simhash.neighbours(df, df).collect())
    assert got == sorted((a, b, d) for a in signed for b in signed if (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= 3)


def test_language_evidence_is_fused(spark, odd, none):
    words = {"en": "the and of with that house", "fr": "le la les des avec maison être", "de": "der die das und mit haus über"}
    rows = [(k, sentences(k, 60, words[lang]), lang, f"{lang}.example.{lang}", 0) for k, lang in enumerate(["en", "fr", "de"] * 30)]
    docs = spark.createDataFrame(rows, DOCS)
    languages, table = language_id.fit(docs)
    assert languages == ["de", "en", "fr"]
    pages = [(1, "http://x.example.fr/a", f"<html lang='fr'><body><script>the and of</script><p>{sentences(5, 40, words['fr'])}</p></body></html>"), (2, None, None), (3, "https://u:p@y.example.de:80/q", "<html lang=de-DE><b>abcd</b>"),
             (4, "not an address", ""), (5, "http://z.org", "zq jx vkw " * 60), (None, "http://x.example.fr/a", "<html lang='xx'>" + sentences(6, 40, words["de"])), (3, "https://u:p@y.example.de:80/q", "<html lang=de-DE><b>abcd</b>")]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("zz")).withColumn("host", F.lit("zz"))
    both = language_id.evidence_of_documents(docs.unionByName(odd.select(*docs.columns))).unionByName(language_id.evidence_of_pages(pages))
    got = language_id.identify(both, languages, table).collect()
    assert len(got) == 90 + odd.count() + 7
    of = {(r.kind, r.id): r for r in got}
    assert all(of["document", k].lang == rows[k][2] for k in range(24, 90))
    assert of["page", 1].lang == "fr" and of["page", 1].declared == "fr" and of["page", 1].host == "x.example.fr"
    assert of["page", 3].host == "y.example.de" and of["page", 3].lang == "de"  # four letters: what is declared decides
    assert of["page", 2].lang == of["page", 4].lang == "und" and not of["page", 2].kept
    assert of["page", 5].lang == "other" and not of["page", 5].kept
    assert of["page", None].lang == "de" and of["page", None].declared == "other"
    assert language_id.identify(language_id.evidence_of_documents(none), languages, table).count() == 0
    assert language_id.fit(none)[0] == []
    assert language_id.identify(language_id.evidence_of_documents(docs), *language_id.fit(none)).filter("kept").count() == 0


def test_rare_languages_and_copies_keep_their_place(spark):
    words = {"en": "the and of with that house", "el": "και το του με σπίτι ήταν", "ka": "და რომ სახლი იყო ეს არის", "nl": "het een van niet huis zijn"}
    rows = [(k, sentences(k, 60, words["en"]), "EN", "s", 0) for k in range(3000)] + [(9000 + k, "one text in many copies " * 3, "en", "s", 0) for k in range(3000)]
    rows += [(20_000 + k, sentences(k, 60, words["el"]), "el", "s", 0) for k in range(4)] + [(30_000, sentences(1, 60, words["ka"]), "ka", "s", 0), (40_000, "het huis van", "nl", "s", 0)]
    rows += [(50_000, "zq jx vkw " * 60, " ", "s", 0), (50_001, " \n\t ", "xx", "s", 0), (50_002, None, "yy", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    languages, table = language_id.fit(docs)
    assert languages == ["el", "en", "ka", "nl"] and table.shape[1] == 5
    _, sample = language_id._sample(docs, 50)
    texts = {}
    for r in sample.collect():
        texts.setdefault(r.lang, []).append(r.text)
    assert {k: len(v) for k, v in texts.items()} == {"el": 4, "en": 50, "ka": 1, "nl": 1} and all(len(set(v)) == len(v) for v in texts.values())
    got = {r.id: r for r in language_id.identify(language_id.evidence_of_documents(docs), languages, table).collect()}
    assert all(got[20_000 + k].lang == "el" and got[20_000 + k].kept for k in range(4)) and got[30_000].lang == "ka" and got[30_000].kept
    assert not got[50_000].kept and all(got[k].lang == "en" for k in range(3000))


_PLAIN = [(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), (2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")]


def _plain_spans(text):
    out = []
    for kind, pattern in _PLAIN:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_fixed_patterns_equal_a_plain_search():
    rng = random.Random(4)
    for alphabet in ("ab@.-_ 1", "0129.. +()-", "@@a.b", "4 1-", "é@a.b 1+"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.base_spans(text) == _plain_spans(text), text
    assert pii.base_spans("4111 1111-1111 1111, +1 (389) 555-5010; 1.2.3.4") == [(1, 40, 47), (2, 0, 19), (3, 21, 38)]
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 50_000):
        pii.base_spans(text)


def test_personal_data_of_all_rows(spark, odd, odd_rows, none):
    rng = random.Random(6)
    number = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    learned = [(k, f"{sentences(k, 8)} {rng.choice([number(), f'u{k}.x@mail{k % 9}.example.com', f'{k % 250 + 1}.14.{k % 99}.7'])} {sentences(k + 1, 8)} version {k % 9}.0 of {k}", "en", "s", 0) for k in range(200)]
    model = pii.fit(spark.createDataFrame(learned, DOCS))
    got = sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(odd, model).collect())
    want = []
    for i, t, *_ in odd_rows:
        s = _plain_spans(t or "")
        want.append((repr(i), *[sum(x[0] == k for x in s) for k in range(4)], hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert got == sorted(want)
    held = [f"{sentences(k, 5)} {x} {sentences(k, 5)}" for k, x in enumerate([f"{number()}" for _ in range(40)] + ["plain words", "chapter 7", "version 3.0"] * 10)]
    found = [bool(x) for x in pii.added_spans(held, [[] for _ in held], *model)]  # the field without the patterns
    assert sum(found[:40]) >= 38 and not any(found[40:])
    clean = pii.redact(odd, model)
    assert clean.columns == odd.columns
    r = clean.filter("doc_id = 108").first().text
    assert "[EMAIL]" in r and "[IP]" in r and "[CARD]" in r and "[PHONE]" in r and not pii.base_spans(r)
    assert clean.filter("text is null").count() == 2
    assert pii.find(none, model).count() == 0 and pii.find(none, pii.fit(none)).count() == 0
    assert pii.replaced("abcdef", [(0, 0, 3), (1, 2, 5)]) == "[EMAIL]f"


def test_gradient_of_the_field():
    """Training raises the likelihood and learns a chain that single words do not show."""
    runs = [[[1], [2]], [[2], [2]], [[1], [3]]] * 5
    labels = [[7, 8], [0, 0], [7, 8]] * 5
    emit, move = pii.train(runs, labels)
    assert [x.tolist() for x in pii.decode(runs[:3], emit, move, caution=0)] == labels[:3]


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, total = {s for s in names if not sizes[s]}, share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else rest * w[s] / free for s in names}
        over = {s for s in names if s not in full and t[s] > most * sizes[s]}
        if not over:
            return t
        full |= over


def test_mix_meets_targets(spark, odd, odd_rows, none):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice([0, 3, 20, 50, 50, 400])), "en", rng.choice(["a", "b", "b", "b", "c", "d", "é", "z", None]), 0) for k in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = _targets(sizes)
    for block in (4000, 60):
        got = mixing.mix(df, block=block).collect()
        by = {r[0]: r[3] for r in rows}
        taken = Counter()
        for r in got:
            assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[by[r.doc_id]] and abs(r.target - want[by[r.doc_id]]) < 1e-6 * r.target
            taken[by[r.doc_id]] += r.taken
        assert len(got) == 900 and all(abs(taken[s] - want[s]) <= 30 for s in want), (taken, want)
        again = mixing.mix(df.repartition(7), block=block).collect()
        assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    edge = mixing.mix(odd)
    assert edge.count() == odd.count() and mixing.mix(none).count() == 0
    rows = mixing.repeated(odd, edge)
    assert rows.columns == odd.columns and rows.count() == edge.agg(F.sum("copies")).first()[0]
    assert mixing.repeated(none, mixing.mix(none)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(9)
    for n in (1, 2, 3, 50):
        sizes, chance = [float(rng.randrange(1, 9)) for _ in range(n)], [rng.random() for _ in range(n)]
        p = mixing.flight(sizes, chance, rng)
        assert sum(0 < x < 1 for x in p) <= 2
        assert abs(sum(p) - sum(chance)) < 1e-6 and abs(np.dot(sizes, p) - np.dot(sizes, chance)) < 1e-6
    share = np.mean([mixing.landing([3.0, 1.0, 2.0, 5.0], [0.2, 0.5, 0.7, 0.4], random.Random(k)) for k in range(4000)], 0)
    assert np.allclose(share[:1], 0.2, atol=0.15)
