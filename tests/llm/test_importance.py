import hashlib
import math
import random
import re
import zlib

import numpy as np
from llm_rows import DOCS, sentences

from billgrid.llm import importance

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _buckets(text):
    words = _WORDS.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _plain(rows, target, least_words=20, percent=5):
    given, wanted = np.zeros(10000), np.zeros(10000)
    for texts, out in (([t for _, t in rows], given), (target, wanted)):
        for text in texts:
            np.add.at(out, _buckets(text)[1], 1)
    gain = [math.floor(1000 * math.log((t + 1) * (given.sum() + 10000) / ((s + 1) * (wanted.sum() + 10000)))) for s, t in zip(given, wanted)]
    out = []
    for i, text in rows:
        n, found = _buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    some = [r for r in out if r[1] >= least_words]
    first = sorted(some, key=lambda r: (-r[4], r[0] is None, r[0] or 0))[: percent * len(some) // 100]
    return out, first


def _check(got, rows, target, **how):
    out, first = _plain(rows, target, **how)
    key = lambda r: tuple(map(repr, r))
    assert sorted(([r.doc_id, r.n_words, r.n_features, r.weight, r.score] for r in got), key=key) == sorted(out, key=key)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(first) + 1))
    assert [(r.score, r.doc_id) for r in drawn] == [(r[4], r[0]) for r in first]


def test_odd_rows_equal_plain_counting(spark, odd, odd_rows, none):
    target = [sentences(k, 20) for k in range(5)] + [None, "", "x\ny"]
    wanted = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id int, text string, doc_id string")
    got = importance.resample(odd, wanted, percent=30)
    assert got.columns == ["doc_id", "key", "n_words", "n_features", "weight", "score", "rank"]
    _check(got.collect(), [r[:2] for r in odd_rows], target, percent=30)
    assert importance.resample(none, wanted).count() == 0
    _check(importance.resample(odd, wanted.limit(0)).collect(), [r[:2] for r in odd_rows], [])


def test_repeated_lines_and_runs_over_newlines(spark):
    rng = random.Random(4)
    lines = [sentences(k, rng.randint(0, 12)) for k in range(30)] + ["", " ", "one", "one two", "É 日本 x1"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for k in range(120)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1])] + [(500 + k, "The same line\nand another. " * 9) for k in range(60)]
    target = [rows[1][1], rows[2][1] + "\n" + lines[4], lines[5]]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    _check(importance.resample(docs, wanted, percent=40).collect(), rows, target, percent=40)


def test_a_distinct_line_is_counted_once(spark, monkeypatch):
    rows = [(k, "the same line of words\n" * 3 + f"own {k}", None, None, None) for k in range(40)]
    found = importance._lines(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 41 and {bytes(r.line): r.n for r in found}[b"the same line of words"] == 120


def test_checksums_of_joined_words():
    rng = random.Random(2)
    for size in (0, 1, 7, 255, 256, 257, 5000):
        a, b = bytes(rng.randrange(256) for _ in range(9)), bytes(rng.randrange(256) for _ in range(size))
        got = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0] ^ np.uint32(zlib.crc32(b))
        assert int(got) == zlib.crc32(a + b)


def test_ranks_over_many_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 3000, 1, 7).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    got = {r.id: r["rank"] for r in importance._numbered(rows, F.desc("v"), F.asc("id")).collect()}
    want = sorted(range(3000), key=lambda i: (-(i * 7919 % 1000), i))
    assert [got[i] for i in want] == list(range(1, 3001))
