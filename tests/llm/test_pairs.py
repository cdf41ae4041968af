import math
import random

import numpy as np
import pytest

from billgrid.llm import common, near_vectors, set_join
from llm_rows import DOCS, sentences


def groups_of(ids, links):
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(300, 301), (301, 302), (302, 300)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == groups_of({x for p in links for x in p}, links)
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def _brute(rows):
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.9]
    return links


@pytest.mark.parametrize("hot", [4096, 3])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(near_vectors, "HOT", hot)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 32))
    near = [base[k % 6] + rng.normal(size=32) * 0.08 for k in range(60)] + [base[9] + rng.normal(size=32) * 0.02 for _ in range(30)] + [base[10]] * 5
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate([*base, *near])]
    rows += [(500, None), (501, []), (502, [0.0] * 32), (503, [1.0, None] + [0.0] * 30), (504, [float("nan")] + [1.0] * 31), (505, [float("inf")] + [1.0] * 31), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [3.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, cid string, v string")
    got = {r.vec_id: r for r in near_vectors.link(df).collect()}
    links = [(rows[a][0], rows[b][0]) for a, b in _brute(rows)]
    found = sum(r.n_links for r in got.values()) / 2
    assert len(got) == len(rows) and 0.97 * len(links) <= found <= len(links)
    want = groups_of([i for i, _ in rows], links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert all(got[i].n_links == 0 for i in range(500, 506))


def _pairs_at(rng, n, dim, mean, low=0.90, high=0.92):
    """Vectors around a common mean, and one partner of each at a cosine of ``low`` to ``high``."""
    x = rng.normal(size=(n, dim)) + mean * rng.normal(size=dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=(n, dim))
    u -= (u * x).sum(1, keepdims=True) * x
    c = rng.uniform(low, high, (n, 1))
    return x, c * x + np.sqrt(1 - c**2) * u / np.linalg.norm(u, axis=1, keepdims=True)


@pytest.mark.parametrize(("key_bits", "mean"), [(16, 0), (20, 0), (22, 0), (24, 0), (16, 1), (20, 1)])
def test_wide_keys_and_large_means_keep_the_recall(monkeypatch, key_bits, mean):
    monkeypatch.setattr(near_vectors, "KEY_BITS", key_bits)
    x, y = _pairs_at(np.random.default_rng(17), 3000, 64, mean)
    codes = near_vectors.Codes(x[:2000], 3000, rounds=10)
    assert codes.key_bits == key_bits
    diff = codes(x[2000:]) ^ codes(y[2000:])
    mask = np.uint64((1 << key_bits) - 1)
    met = np.any([np.bitwise_count((diff[:, t // codes.per_rotation] >> np.uint64(t % codes.per_rotation * key_bits)) & mask) <= 1 for t in range(codes.tables)], axis=0)
    assert (met & (np.bitwise_count(diff).sum(1) <= codes.radius)).mean() >= 0.95


def test_links_just_above_the_threshold_with_wide_keys(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "KEY_BITS", 24)
    x, y = _pairs_at(np.random.default_rng(18), 300, 64, 0.5)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    links = len(_brute(rows))
    found = sum(r.n_links for r in near_vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) / 2
    assert 300 <= links and 0.95 * links <= found <= links


def test_repeated_and_null_ids_of_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.001]), (None, [0.0, 1.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_vectors.link(df).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("4", 1, 4, True), ("None", 1, 4, False), ("None", 2, 1, False)]
    assert near_vectors.link(df.limit(0)).count() == 0


def _sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def _jaccard_links(rows):
    s = [_sets(t) for _, t, *_ in rows]
    return [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]


def test_vectors_of_extreme_length(spark):
    """Their squares are zero or infinite in doubles; cosines are as of any length."""
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    sizes = [1e-170, 1e-300, 1.0, 1e160, 1e300, 5e-200]
    rows = [(10 * k + j, [x * size for x in base[k]]) for k in range(6) for j, size in enumerate(sizes)] + [(99, [5e-324] + [0.0] * 11)]
    got = {r.vec_id: r for r in near_vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) >= 0.9
    assert not any(near(a, b) for k, a in enumerate(base) for b in base[:k])
    assert all(got[10 * k + j].n_links == 5 and got[10 * k + j].component_id == 10 * k for k in range(6) for j in range(6)) and got[99].n_links == 0


def _varied(seed, copies, edits):
    rng = random.Random(seed)
    base = sentences(seed, 80).split()
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w += [f"tail{rng.randrange(99)}"] * rng.randrange(25)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("settings", [{}, {"HOT": 3, "FREQUENT": 2, "LEADING": 1, "SHARED": 1}, {"FREQUENT": 10**6, "LEADING": 1, "SHARED": 99, "CELLS": 50}])
def test_set_join_equals_all_pairs(spark, odd_rows, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(set_join, name, value)
    passage = sentences(777, 60)
    texts = _varied(1, 40, 4) + _varied(2, 25, 2) + _varied(3, 10, 1) + [passage + " " + sentences(k, 10 + 5 * (k % 9)) for k in range(1000, 1030)]
    rows = [(1000 + k, t, "en", "s", 0) for k, t in enumerate(texts)] + [r for r in odd_rows if r[0] is not None and r[0] != 103]
    got = {r.doc_id: r for r in set_join.join_groups(spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "rid")).collect()}
    assert {i: got[i].n_shingles for i, *_ in rows} == {i: len(_sets(t)) for i, t, *_ in rows}
    want = groups_of([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in _jaccard_links(rows)])
    assert {i: r.component_id for i, r in got.items()} == want


def test_one_row_of_each_group_stays(spark, odd, odd_rows, none):
    kept = set_join.one_of_each(odd)
    assert kept.columns == odd.columns
    got = sorted((repr(r.doc_id), r.text or "") for r in kept.collect())
    rows = list(odd_rows)
    groups = groups_of(range(len(rows)), _jaccard_links(rows))
    least = {}
    for k, (i, t, *_) in enumerate(rows):
        least.setdefault(groups[k], []).append((i is None, i, t or ""))
    want = sorted((repr(i), t) for g in least.values() for _, i, t in [min(g, key=lambda x: (x[0], x[1] or 0))])
    assert got == want
    assert set_join.one_of_each(none).count() == 0 and set_join.join_groups(none).count() == 0
