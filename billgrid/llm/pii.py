"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billgrid.llm import common

KINDS = ("email", "ip", "card", "phone")
#: States: outside, then begin and inside of each kind.
STATES = 1 + 2 * len(KINDS)
#: Hashed features; labelled texts (about so many) and the longest of them; runs of words learned from.
WIDTH, FIT_ROWS, FIT_CHARS, FIT_RUNS = 1 << 13, 1500, 50_000, 4000
ROUNDS, RATE, PENALTY = 120, 0.3, 1e-3
#: Log odds that a span needs beyond the best reading without it.
CAUTION = 2.0

Span = tuple[int, int, int]  # kind (place in KINDS), start, end in code points

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Every match holds one @: its local part is the longest run before it that no earlier match has."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind's pattern that pass its check; by kind, then start."""
    out = list(_emails(text))
    if _DIGIT_OR_AT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _shape(word: str) -> str:
    """Digits as 9, letters as x or X, runs of letters and runs beyond 19 digits as one."""
    s = "".join("9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:64])
    return re.sub(r"9{20,}", "9+", re.sub(r"([xX])\1+", r"\1", s))


def candidate_runs(text: str) -> Iterator[tuple[list[tuple[int, int]], str, str]]:
    """Runs of neighbouring words that hold a digit or @ in one line, with the words around them.

    Other words are outside by definition of the field (no label but outside is open to them), so
    runs are decoded one by one without loss.
    """
    at = 0
    for line in text.split("\n"):
        if _DIGIT_OR_AT.search(line):
            run: list[tuple[int, int]] = []
            before = last = ""
            for m in _WORD.finditer(line):
                if _DIGIT_OR_AT.search(m[0]):
                    if not run:
                        before = last
                    run.append((at + m.start(), at + m.end()))
                elif run:
                    yield run, before, m[0]
                    run = []
                last = m[0]
            if run:
                yield run, before, ""
        at += len(line) + 1


def features(words: list[str], before: str, after: str) -> list[list[int]]:
    """Hashed features of each word: its shape, parts of it, and its neighbours' shapes."""
    shapes = [_shape(w) for w in [before, *words, after]]
    out = []
    for k, w in enumerate(words, 1):
        bare = shapes[k].strip(".,;:!?\"'()[]<>")
        named = (f"s{shapes[k]}", f"b{bare}", f"p{shapes[k - 1]}", f"n{shapes[k + 1]}", f"l{min(len(w), 24)}", f"d{min(sum('0' <= c <= '9' for c in w), 20)}",
                 f"c{''.join(sorted(set(re.sub('[9xX]', '', bare))))}", f"f{bare[:1]}", "bias")
        out.append([zlib.crc32(x.encode()) % WIDTH for x in named])
    return out


def _padded(runs: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (run, word, feature) and which words are there."""
    longest = max(map(len, runs))
    ids = np.zeros((len(runs), longest, len(runs[0][0])), np.int32)
    there = np.zeros((len(runs), longest), bool)
    for k, r in enumerate(runs):
        ids[k, : len(r)] = r
        there[k, : len(r)] = True
    return ids, there


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _allowed() -> np.ndarray:
    """Transitions: the inside of a kind follows only its begin or inside."""
    a = np.zeros((STATES, STATES))
    for s in range(STATES):
        for t in range(2, STATES, 2):
            if s not in (t - 1, t):
                a[s, t] = -1e4
    return a


def train(runs: list[list[list[int]]], labels: list[list[int]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, state) and (state, state) that raise the likelihood of ``labels``: exact
    gradients by forward and backward sums over all runs at once, adaptive steps."""
    emit, move = np.zeros((WIDTH, STATES)), np.zeros((STATES, STATES))
    if not runs:
        return emit, move
    ids, there = _padded(runs)
    n, longest = there.shape
    gold = np.zeros((n, longest), np.int64)
    for k, y in enumerate(labels):
        gold[k, : len(y)] = y
    wanted, wanted_moves = np.zeros_like(emit), np.zeros_like(move)
    np.add.at(wanted, (ids[there], gold[there][:, None]), 1.0)
    both = there[:, 1:] & there[:, :-1]
    np.add.at(wanted_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    wanted_moves[0] += np.bincount(gold[:, 0], minlength=STATES)  # from outside into the run
    seen, seen_moves = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    for _ in range(rounds):
        score, step = emit[ids].sum(2), move + _allowed()
        forward = np.empty((n, longest, STATES))
        forward[:, 0] = score[:, 0] + step[0]
        for t in range(1, longest):
            forward[:, t] = np.where(there[:, t, None], score[:, t] + _log_sum(forward[:, t - 1, :, None] + step, 1), forward[:, t - 1])
        all_ = _log_sum(forward[:, -1], 1)
        backward = np.zeros((n, longest, STATES))
        moved = np.zeros_like(move)
        for t in range(longest - 1, 0, -1):
            inner = score[:, t] + backward[:, t]
            pair = np.exp(forward[:, t - 1, :, None] + step + inner[:, None, :] - all_[:, None, None])
            moved += pair[there[:, t]].sum(0)
            backward[:, t - 1] = np.where(there[:, t, None], _log_sum(step[None] + inner[:, None, :], 2), 0.0)
        chance = np.exp(forward + backward - all_[:, None, None])
        moved[0] += chance[:, 0].sum(0)
        expected = np.zeros_like(emit)
        for f in range(ids.shape[2]):
            np.add.at(expected, ids[:, :, f][there], chance[there])
        for w, g, h in ((emit, wanted - expected - PENALTY * n * emit / 100, seen), (move, wanted_moves - moved - PENALTY * n * move / 100, seen_moves)):
            h += g * g
            w += RATE * g / np.sqrt(h)
    return emit, move


def decode(runs: list[list[list[int]]], emit: np.ndarray, move: np.ndarray, caution: float = CAUTION, cells: int = 200_000) -> list[np.ndarray]:
    """Best states of each run by Viterbi, in batches of runs of like length."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
    step = move + _allowed()
    order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(runs[order[end]]) * (end + 1 - at) <= cells:
            end += 1
        batch = order[at:end]
        ids, there = _padded([runs[k] for k in batch])
        score = np.stack([emit[ids[:, t]].sum(1) for t in range(ids.shape[1])], 1)
        score[:, :, 1::2] -= caution
        best, came = score[:, 0] + step[0], []
        for t in range(1, ids.shape[1]):
            options = best[:, :, None] + step
            came.append(np.where(there[:, t, None], options.argmax(1), np.arange(STATES)).astype(np.int8))
            best = np.where(there[:, t, None], options.max(1) + score[:, t], best)
        state = best.argmax(1)
        path = [state]
        for back in reversed(came):
            state = back[np.arange(len(batch)), state]
            path.append(state)
        states = np.stack(path[::-1], 1)
        for k, s in zip(batch, states):
            out[k] = s[: len(runs[k])]
        at = end
    return out


def _labels(run: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """States of a run's words by the spans that overlap them."""
    out = []
    for k, (start, end) in enumerate(run):
        hit = next((s for s in spans if s[1] < end and start < s[2]), None)
        out.append(0 if hit is None else 2 + 2 * hit[0] if k and hit[1] < run[k - 1][1] and out[-1] in (1 + 2 * hit[0], 2 + 2 * hit[0]) else 1 + 2 * hit[0])
    return out


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A field trained on a small labelled table: about ``rows`` texts with a digit or @, drawn by a
    hash of the text, whose words carry the labels of the fixed patterns. Texts beyond ``FIT_CHARS``
    characters are not drawn, and at most ``FIT_RUNS`` runs are learned from."""
    some = docs.select("text").filter(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= FIT_CHARS))
    n = some.count()
    drawn = some.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, n // rows))) == 0).distinct().limit(2 * rows).collect()
    runs, labels = [], []
    for text in sorted(r.text for r in drawn):
        spans = base_spans(text)
        for run, before, after in candidate_runs(text):
            if len(run) <= 50:
                runs.append(features([text[a:b] for a, b in run], before, after))
                labels.append(_labels(run, spans))
    keep = sorted(range(len(runs)), key=lambda k: zlib.crc32(repr(runs[k]).encode()))[:FIT_RUNS]
    return train([runs[k] for k in keep], [labels[k] for k in keep])


def added_spans(texts: list[str], base: list[list[Span]], emit: np.ndarray, move: np.ndarray) -> list[list[Span]]:
    """Spans that the field finds beside ``base``, without those that overlap one of them."""
    owner, where, runs = [], [], []
    for k, text in enumerate(texts):
        for run, before, after in candidate_runs(text):
            owner.append(k)
            where.append(run)
            runs.append(features([text[a:b] for a, b in run], before, after))
    out: list[list[Span]] = [[] for _ in texts]
    for k, run, states in zip(owner, where, decode(runs, emit, move) if runs else ()):
        i = 0
        while i < len(run):
            if states[i] % 2:
                j = i + 1
                while j < len(run) and states[j] == states[i] + 1:
                    j += 1
                a, b = run[i][0], run[j - 1][1]
                while a < b and texts[k][a] in "\"'[<":
                    a += 1
                while a < b and texts[k][b - 1] in ".,;:!?\"'])>":
                    b -= 1
                if a < b and not any(s[1] < b and a < s[2] for s in base[k]):
                    out[k].append(((int(states[i]) - 1) // 2, a, b))
                i = j
            else:
                i += 1
    return out


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _batches(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[start : k + 1]
            start, size = k + 1, 0
    yield texts[start:]


def spans_of(texts: list[str], emit: np.ndarray, move: np.ndarray) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base, added) spans of each text."""
    for part in _batches(texts):
        base = [base_spans(t) for t in part]
        yield from zip(base, added_spans(part, base, emit, move))


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the fixed patterns), base_sha256, spans (all of
    them), n_added of every row of ``docs`` (doc_id, text).

    One pass without a shuffle over whole texts; the model has a fixed size and goes to executors
    once. Null and empty texts have no spans; repeated rows, ties and null ids give a row each; an
    empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [([sum(s[0] == k for s in base) for k in range(4)], hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more]), len(more))
                    for base, more in spans_of([t or "" for t in common.strings(batch.column("text"))], *shared.value)]
            data = {"doc_id": batch.column("doc_id")} | {f"n_{name}": pa.array([r[0][k] for r in rows], pa.int64()) for k, name in enumerate(KINDS)}
            yield pa.record_batch(data | {"base_sha256": pa.array([r[1] for r in rows], pa.string()), "spans": pa.array([r[2] for r in rows], pa.string()), "n_added": pa.array([r[3] for r in rows], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; other columns stay, and
    so do null texts. Where spans overlap, the stretch they cover is replaced once, by the first's kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = common.strings(batch.column(text))
            out = [t if t is None else replaced(t, [*base, *more]) for t, (base, more) in zip(given, spans_of([t or "" for t in given], *shared.value))]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
