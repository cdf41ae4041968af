import hashlib
import math
import random

import numpy as np
import pytest

from billgrid.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, codes string, error string, entry int, part string"


def _plain(rows, entries=256, parts=4, rounds=4, scale=1024):
    """Every distance in Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in rows) // parts) * parts
    d = width // parts
    floor = lambda x: int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)
    whole = [[floor(x) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][1])))[:entries]
    cut = lambda p: [w[p * d : (p + 1) * d] for w in whole]
    books = [[cut(p)[i] for i in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(x, books[p])[1] for x in cut(p)]
            for j in range(len(books[p])):
                mine = [x for x, k in zip(cut(p), of) if k == j]
                if mine:
                    books[p][j] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [[nearest(x, books[p]) for x in cut(p)] for p in range(parts)]
    out = [(repr(r[0]), repr(r[2]), "".join(f"{found[p][i][1]:02x}" for p in range(parts)), sum(found[p][i][0] for p in range(parts))) for i, r in enumerate(rows)]
    return sorted(out), hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


def _vectors(n, width, size=0.5, seed=1):
    rng = random.Random(seed)
    heart = [[rng.gauss(0, size) for _ in range(width)] for _ in range(5)]
    return [(k, [x + rng.gauss(0, size / 5) for x in heart[rng.randrange(5)]], rng.choice([0, 1, None])) for k in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", 1, "p") for r in rows], SCHEMA).repartition(3)


def _run(spark, rows, entries):
    found, books = vector_codes.compress(_frame(spark, rows), entries=entries)
    got = vector_codes.label_errors(found).collect()
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got)
    return sorted((repr(r.vec_id), repr(r.label), r.code, r.error) for r in got), vector_codes.digest(books)


def test_codes_equal_all_distances(spark):
    rows = _vectors(300, 16)
    rows += [(7, rows[7][1], 1), (7, rows[8][1], None), (None, rows[9][1], 0), (900, None, 1), (901, [0.1, None] + [0.0] * 14, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, None), (904, [], 0), (905, [1e-170] * 16, 0), (906, [0.25] * 5, 1)]
    rows += [(2000 + k, rows[3][1], 2) for k in range(100)]  # a third of all rows alike
    assert _run(spark, rows, 40) == _plain(rows, 40)


def test_wide_components_and_odd_lengths(spark):
    rows = [(k, e[:6], label) for k, e, label in _vectors(40, 8, 3e5)]
    assert _run(spark, rows, 20) == _plain(rows, 20)
    found, books = vector_codes.compress(_frame(spark, [*rows, (99, [1e300, -1e308], 5)]), entries=8)
    last = found.filter("vec_id = 99").first()
    assert last.error is None or last.error >= 0
    assert vector_codes.digest(books) == _plain([*rows, (99, [1e300, -1e308], 5)], 8)[1]


def test_few_and_no_vectors(spark):
    rows = _vectors(3, 4)
    assert _run(spark, rows, 256) == _plain(rows, 256)
    none, books = vector_codes.compress(_frame(spark, rows).limit(0))
    assert vector_codes.label_errors(none).count() == 0 and books.written() == ""
    empty, books = vector_codes.compress(_frame(spark, [(1, [], 0), (2, [], None)]))
    assert [r.code for r in empty.collect()] == ["00000000"] * 2 and books.written() == ""


@pytest.mark.parametrize("seed", range(3))
def test_bounds_skip_most_distances_and_change_nothing(seed):
    rng = np.random.default_rng(seed)
    hearts = rng.integers(-300, 300, (60, 8))
    x = (hearts[rng.integers(0, 60, 3000)] + rng.integers(-20, 20, (3000, 8))).astype(float)
    books = [x[:64].copy()]
    codes, errors, bounds = vector_codes.first_assignment(x, books[0])
    stamps, looked = np.zeros(bounds.shape, np.int64), 0
    for _ in range(5):
        book = books[-1].copy()
        for j in range(64):
            if (codes == j).any():
                book[j] = np.floor(x[codes == j].sum(0) / (codes == j).sum())
        books.append(book)
        codes, errors, bounds, stamps, more = vector_codes.next_assignment(x, books, codes, bounds, stamps)
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (codes == far.argmin(1)).all() and (errors == far.min(1)).all()
        looked += more
    assert looked < 0.5 * 5 * len(x) * 64


def test_net_displacement_is_less_than_drifts():
    books = [np.array([[0.0, 0.0]]), np.array([[10.0, 0.0]]), np.array([[1.0, 0.0]])]
    assert vector_codes.displacements(books)[0, 0] == pytest.approx(1) and vector_codes.displacements(books)[1, 0] == pytest.approx(9)
