"""Text similarity (F37): the one pandas UDF of the library.

Spark's built-in distances (Levenshtein and friends) give other numbers than the
longest-matching-blocks ratio the 0.85 vendor threshold is calibrated on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def blocks_ratio(a: str, b: str) -> float:
    """Ratio of the longest-matching-blocks method, as difflib's SequenceMatcher (without junk) has it.

    The longest block, the first in ``a`` and then in ``b`` among equals, is found by searches for slices,
    which is several times faster for short names; what lies before and after it is compared likewise.
    """
    if not a and not b:
        return 1.0
    matched, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        start = size = i = 0
        while (end := i + size + 1) <= len(x):
            if x[i:end] in y:
                start, size = i, size + 1
            else:
                i += 1
        if size:
            end, at = start + size, y.find(x[start : start + size])
            matched += size
            if start and at:
                todo.append((x[:start], y[:at]))
            if end < len(x) and at + size < len(y):
                todo.append((x[end:], y[at + size :]))
    return 2.0 * matched / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = blocks_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    """Ratio in 0..1. Equal texts never reach Python: they are 1.0 by definition."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(a == b, F.lit(1.0)).otherwise(_blocks_ratio(F.when(a != b, a), b))


#: Classes of characters that a text's spectrum counts.
CLASSES = 32


def spectrum(c: Column) -> Column:
    """How many characters of each class (code point modulo CLASSES) a text has."""
    chars = F.split(F.coalesce(c, F.lit("")), "")
    return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.size(F.filter(chars, lambda x: (x != "") & (F.pmod(F.ascii(x), F.lit(CLASSES)) == k))))


def similarity_bound(a: Column, spectrum_a: Column, b: Column, spectrum_b: Column) -> Column:
    """A ratio that :func:`text_similarity` of two texts doesn't exceed: no more characters can match than
    both have of a class. Built-in functions only."""
    shared = F.aggregate(F.zip_with(spectrum_a, spectrum_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * shared / F.greatest(F.length(a) + F.length(b), F.lit(1))))


@F.pandas_udf(DoubleType())
def _best_ratio(a: pd.Series, options: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for name, others in zip(a, options):
        best = 0.0
        for other in [] if name is None or others is None else others:
            if (name, other) not in known:
                known[name, other] = blocks_ratio(name, other)
            best = max(best, known[name, other])
        out.append(best)
    return pd.Series(out, dtype="float64")


def best_similarity(a: Column, options: Column) -> Column:
    """Highest ratio of a text to any of an array of texts; 0.0 where either is NULL."""
    return _best_ratio(a, options)
