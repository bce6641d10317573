"""Quality rules by labelling the sequence of lines.

A linear-chain conditional random field with the states *content* and *boilerplate* is fitted
on a bounded sample of labelled documents (SAMPLE rows); Viterbi decoding marks each line of
a text, and the share of its characters on content lines decides whether it stays. Counts
behind the plain rules (words, symbols, repeated lines and windows) cover the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import settings

CONTENT, BOILERPLATE = 0, 1
SAMPLE = 2000  # labelled documents the model is fitted on, at most
SAMPLE_BYTES = 6_000  # longer documents are not taken into that sample
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(0x41, 0x5B))
DIGITS = b"0123456789"
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words

# Borders between the bins of each line measure; a measure's bins are its features.
BINS: dict[str, tuple[float, ...]] = {
    "symbols": (0.001, 0.01, 0.03, 0.08, 0.15),
    "exclamations": (0.001, 0.02, 0.08),
    "capitals": (0.06, 0.15, 0.4, 0.8),
    "repeated_words": (0.01, 0.1, 0.3, 0.6),
    "distinct_words": (0.3, 0.5, 0.7, 0.9),
    "digits": (0.01, 0.05, 0.2),
    "word_length": (3, 4.5, 6, 8, 12),
    "words": (1, 3, 6, 12, 30, 80),
    "ends_sentence": (0.5,),
    "seen_before": (0.5,),
}
FEATURES = sum(len(b) + 1 for b in BINS.values())
_FIRST = np.cumsum([0, *(len(b) + 1 for b in BINS.values())])[:-1]
_EDGES = [np.array(b) for b in BINS.values()]


def _count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def _measures(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    n, k = max(1, len(line)), max(1, len(words))
    return (
        _count(line, SYMBOLS) / n,
        line.count(b"!") / n,
        _count(line, CAPITALS) / n,
        sum(map(eq, words, words[1:])) / k,
        len(set(words)) / k,
        _count(line, DIGITS) / n,
        sum(map(len, words)) / k,
        len(words),
        float(line.rstrip()[-1:] in (b".", b"?", b":")),
        float(seen),
    )


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word: the numbers of its features, and its length in bytes."""
    found, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            found.append(_measures(line, words, line in seen))
            sizes.append(len(line))
            seen.add(line)
    values = np.array(found).reshape(-1, len(BINS))
    numbers = np.stack([np.searchsorted(e, values[:, i], side="right") + _FIRST[i] for i, e in enumerate(_EDGES)], axis=1)
    return numbers, np.array(sizes, np.int64)


@dataclass
class Model:
    """Weights of the field: states by features, transitions, and the least share of content."""

    weights: np.ndarray
    transitions: np.ndarray
    share: float

    def decode(self, numbers: np.ndarray) -> np.ndarray:
        """The likeliest states of a sequence of lines (Viterbi)."""
        scores = self.weights[:, numbers].sum(axis=2).T
        n = len(scores)
        if not n:
            return np.zeros(0, np.int8)
        (aa, ab), (ba, bb) = self.transitions.tolist()
        a, b = scores[0].tolist()
        back = np.zeros((n, 2), np.int8)
        for t, (x, y) in enumerate(scores[1:].tolist(), 1):
            back[t] = (a + aa < b + ba, a + ab < b + bb)
            a, b = max(a + aa, b + ba) + x, max(a + ab, b + bb) + y
        states = np.empty(n, np.int8)
        states[-1] = a < b
        for t in range(n - 1, 0, -1):
            states[t - 1] = back[t, states[t]]
        return states

    def content_share(self, text: bytes) -> float:
        """Share of the bytes of lines with a word that are on content lines; 0 for no such line."""
        numbers, sizes = features(text)
        return float(sizes[self.decode(numbers) == CONTENT].sum() / sizes.sum()) if len(sizes) else 0.0


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _expected(weights, transitions, sequences, widest: int):
    """State and transition probabilities of all sequences, by forward and backward passes in step."""
    lengths = np.array([len(s) for s in sequences])
    scores = np.zeros((len(sequences), widest, 2))
    for i, s in enumerate(sequences):
        scores[i, : len(s)] = weights[:, s].sum(axis=2).T
    inside = np.arange(widest) < lengths[:, None]
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, widest):
        step = _log_sum(forward[:, t - 1, :, None] + transitions, 1) + scores[:, t]
        forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
    for t in range(widest - 2, -1, -1):
        step = _log_sum(transitions + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
    total = _log_sum(forward[:, -1], 1)
    states = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
    pairs = np.exp(
        forward[:, :-1, :, None]
        + transitions
        + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
        - total[:, None, None, None]
    )
    return states, (pairs * inside[:, 1:, None, None]).sum(axis=(0, 1)), inside


def fit_field(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, ridge: float = 1.0):
    """Weights and transitions of largest conditional likelihood, by accelerated gradient ascent."""
    widest = max(map(len, sequences))
    weights, transitions = np.zeros((2, FEATURES)), np.zeros((2, 2))
    gold_w, gold_t = np.zeros_like(weights), np.zeros_like(transitions)
    for s, y in zip(sequences, labels, strict=True):
        for state in (0, 1):
            gold_w[state] += np.bincount(s[y == state].ravel(), minlength=FEATURES)
        np.add.at(gold_t, (y[:-1], y[1:]), 1)
    seen_w, seen_t = np.zeros_like(weights), np.zeros_like(transitions)
    for _ in range(rounds):
        states, pairs, inside = _expected(weights, transitions, sequences, widest)
        model = np.zeros_like(weights)
        flat, owner = np.concatenate(sequences), states[inside]
        for state in (0, 1):
            for column in flat.T:
                model[state] += np.bincount(column, owner[:, state], FEATURES)
        slope_w, slope_t = gold_w - model - ridge * weights, gold_t - pairs - ridge * transitions
        seen_w, seen_t = seen_w + slope_w**2, seen_t + slope_t**2
        weights += 0.5 * slope_w / np.sqrt(seen_w + 1e-9)
        transitions += 0.5 * slope_t / np.sqrt(seen_t + 1e-9)
    return weights, transitions


def fit_model(texts: list[bytes], good: list[bool]) -> Model:
    """Fit lines from labels of whole texts.

    Lines start with their text's label. Then lines of bad texts that a first field calls
    content are relabelled, but for texts it calls content throughout, and the field is fitted
    again. The least share of content is the one that parts the labelled texts best.
    """
    made = [(features(t), g) for t, g in zip(texts, good, strict=True)]
    made = [((s, n), g) for (s, n), g in made if len(s)]
    if len({g for _, g in made}) < 2:
        return Model(np.zeros((2, FEATURES)), np.zeros((2, 2)), 0.0)
    sequences = [s for (s, _), _ in made]
    labels = [np.full(len(s), CONTENT if g else BOILERPLATE) for (s, _), g in made]
    model = Model(*fit_field(sequences, labels), 0.0)
    for i, ((s, _), g) in enumerate(made):
        states = model.decode(s)
        if not g and states.any():
            labels[i] = states.astype(np.int64)
    model = Model(*fit_field(sequences, labels), 0.0)
    shares = np.array([n[model.decode(s) == CONTENT].sum() / n.sum() for (s, n), _ in made])
    is_good = np.array([g for _, g in made])
    # Losing a good text counts as much as keeping five bad ones.
    borders = np.unique(np.concatenate([[0.0], shares]))
    lost = [5 * (is_good & (shares < b)).sum() + (~is_good & (shares >= b)).sum() for b in borders]
    best = np.flatnonzero(np.array(lost) == min(lost))
    model.share = float(borders[best[0]])
    return model


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    names, width = ids, 1
    while width < window:  # names of windows of one word more, still exact
        pairs = names[: n - width] * (n + 1) + ids[width:]
        names, width = np.unique(pairs, return_inverse=True)[1], width + 1
    often = np.bincount(names)[names] > 1
    covered = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(often)
    covered[at] += 1
    np.subtract.at(covered, at + window, 1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated windows."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    points = sum(map(len, words)) - int(((data & 0xC0) == 0x80).sum())
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(words), points, _count(text, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def _score(key: str, text: str, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(text).cast(pa.binary())]
            columns = np.array([counts(t) for t in texts], np.int64).reshape(-1, 5).T
            share = np.array([model.content_share(t) for t in texts])
            failed = (columns[0] < LEAST_WORDS) | (100 * columns[4] > MOST_REPEATED * columns[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *map(pa.array, columns), *map(pa.array, (share, failed, ~failed & (share >= model.share)))],
                names=[key, *COUNTS, "content_share", "base_failed", "kept"],
            )

    return run


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit a model on at most SAMPLE labelled rows of ``docs``, chosen by a hash of their key.

    Labels are 1 (good) and 0; null labels and texts are left out. Without labels of both
    kinds the model calls everything content, so the plain rules decide alone.
    """
    chosen = labels.where(F.col(label).isNotNull()).select(key, F.col(label).alias("_good"))
    chosen = chosen.orderBy(F.xxhash64(key), key, "_good").limit(SAMPLE)
    short = docs.select(key, F.col(text).alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    # At most SAMPLE small rows are broadcast.
    rows = short.join(F.broadcast(chosen), key).orderBy(key, "_text").limit(SAMPLE).collect()
    return fit_model([r["_text"].encode() for r in rows], [r["_good"] == 1 for r in rows])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the counts of COUNTS, ``content_share``, ``base_failed`` and ``kept`` for every row.

    A row fails the plain rules with fewer than LEAST_WORDS words or more than MOST_REPEATED
    per cent of them in repeated windows; else its share of content decides. A null or empty
    text has no words and fails. Repeated rows are judged each; other columns are ignored.
    """
    settings(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    schema += ", content_share double, base_failed boolean, kept boolean"
    return docs.select(key, text).mapInArrow(_score(key, text, model), schema)


def _keep(text: str, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x in batch.column(text).cast(pa.binary()):
                value = x.as_py() or b""
                words = value.split()
                failed = len(words) < LEAST_WORDS or 100 * repeated_words(words) > MOST_REPEATED * len(words)
                kept.append(not failed and model.content_share(value) >= model.share)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns and without a shuffle."""
    settings(docs.sparkSession)
    return docs.mapInArrow(_keep(text, model), docs.schema)
