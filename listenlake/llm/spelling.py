"""Spelling variants by a trie of letter counts.

A word's vector holds how often each group of letters occurs in it; level by level the counts
lead down a trie. One inserted, deleted or replaced code point adds one to at most one count and
takes one from at most one other. So a word's near words lie where a depth-first search ends
that follows the word's own counts and may spend one surplus and one deficit on its way. What
leaves hold is verified on the words themselves.

Of two words whose counts differ, the one with less at the first difference searches for the
other: it spends its surplus there and has one deficit left. Each pair so meets once. The upper
levels are dealt out: a prefix of the trie that holds more than CELL words is split, every other
one is a cell, and a word is sent to its own cell and, as a search, to those its budget reaches.
Cells go on with the same descent in memory and return one row a word, not one a pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import settings, stage

# One level of the trie each; whatever is in none of them has the last level.
GROUPS = [*"eainrotsldcumgphb", "fkv", "ywzjqx"]
LEVELS = len(GROUPS) + 1
MOST = 255  # counts beyond are kept as this: two counts one apart stay at most one apart
CELL = 1 << 16  # words of a cell, about
SMALL = 64  # words of a leaf in memory
AT_ONCE = 1 << 22  # pairs compared at once
ROUTED = 1 << 16  # words sent out at once
HELD = 1 << 19  # distinct words a task counts before it passes them on
WIDE = 64  # longer words are compared one pair at a time
ROUND = 4  # levels measured at once
HOME, SPENT, SEARCH = range(3)  # a word of the cell; a search without its deficit; one with it


def _level_of() -> np.ndarray:
    level = np.full(256, LEVELS - 1, np.int64)
    for i, letters in enumerate(GROUPS):
        level[list(letters.encode())] = i
    return level


LEVEL_OF = _level_of()


def _counted(key: str, text: str, least: int, spoil: int | None):
    # In Latin-1 the letters are single bytes; whatever it lacks becomes '?', which ends a run as well.
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def own_words(name, value: str):
        found = Counter(runs.findall(value.encode("latin-1", "replace").lower()))
        if not spoil:
            return found.items()
        start = zlib.crc32(f"{'' if name is None else name}:".encode())
        out = []
        for word, n in found.items():
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
            if h % spoil == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                out.append((word, n))
        return out

    def rows(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for name, value in zip(batch.column(key), batch.column(text), strict=True):
                for word, n in own_words(name.as_py(), value.as_py() or ""):
                    counts[word] += n
                if len(counts) >= HELD:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return run


def vocabulary(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = 7,
    occurrences: int = 2,
    spoil: int | None = None,
) -> DataFrame:
    """``word, n``: distinct words of at least ``least`` code points and ``occurrences`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With ``spoil``,
    one run in so many is misspelt first: where the CRC-32 of ``<key>:<run>`` is a multiple, the
    code point at that CRC modulo the run's length goes (a null key is written as nothing).
    Null and empty texts have no words; texts and runs of any length are read whole; repeated
    rows count again; an empty table has no words; other columns are ignored.
    """
    settings(docs.sparkSession)
    counts = docs.select(key, text).mapInArrow(_counted(key, text, least, spoil), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def vectors(words: list[bytes]) -> np.ndarray:
    """For each Latin-1 word its counts by level, each in one byte."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    cells = np.repeat(np.arange(len(words)), sizes) * LEVELS + LEVEL_OF[np.frombuffer(b"".join(words), np.uint8)]
    return np.minimum(np.bincount(cells, minlength=len(words) * LEVELS), MOST).astype(np.uint8).reshape(-1, LEVELS)


def descend(paths: np.ndarray, kinds: np.ndarray, level: int, split: Callable, leaf: Callable, prune: bool) -> None:
    """Depth-first search of all rows of ``paths`` at once, from ``level`` on.

    Ends with ``leaf(prefix, rows, kinds)`` where ``split(prefix, words)`` is false. With ``prune``
    the words given are all there are, so branches without any are left out.
    """

    def visit(prefix: bytes, level: int, own: np.ndarray, kinds: np.ndarray):
        home = kinds == HOME
        words = int(home.sum())
        if prune and not words:
            return
        if level == LEVELS or not split(prefix, words):
            leaf(prefix, own, kinds)
            return
        count = paths[own, level].astype(np.int64)
        search = kinds == SEARCH
        for c in np.unique(np.concatenate([count, count[home] + 1, count[search] - 1])).tolist():
            if 0 <= c <= MOST:
                same = count == c
                lacks = own[home & (count == c - 1)]  # spend their surplus here
                has = own[search & (count == c + 1)]  # spend their deficit here
                then = [kinds[same], np.full(len(lacks), SEARCH), np.full(len(has), SPENT)]
                visit(prefix + bytes([c]), level + 1, np.concatenate([own[same], lacks, has]), np.concatenate(then))

    visit(b"", level, np.arange(len(paths)), kinds)


def _splits(words: DataFrame) -> frozenset[bytes]:
    """All prefixes that hold more than CELL words; at most LEVELS / CELL of the number of words."""
    found, level = {b""} if words.count() > CELL else set(), 0
    while len(last := [p for p in found if len(p) == level]) and level < LEVELS:
        within = words
        if level:
            split = words.sparkSession.createDataFrame([(p,) for p in last], "split binary")
            within = words.join(split, F.substring("path", 1, level) == F.col("split"), "left_semi")
        depths = range(level + 1, min(level + ROUND, LEVELS) + 1)
        prefix = F.explode(F.array(*[F.substring("path", 1, d) for d in depths])).alias("prefix")
        large = within.select(prefix).groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
        found |= {bytes(r["prefix"]) for r in large.select("prefix").collect()}
        level = depths[-1]
    return frozenset(found)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        paths = pa.array([v.tobytes() for v in vectors(words)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, paths], names=["word", "n", "path"])


def _route(splits: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            words = np.array([w.encode("latin-1") for w in table.column("word").to_pylist()], object)
            n = table.column("n").to_numpy()
            paths = np.frombuffer(b"".join(table.column("path").to_pylist()), np.uint8).reshape(-1, LEVELS)
            out = []

            def leaf(prefix, own, kinds):
                if len(own):
                    out.append((prefix, b"\n".join(words[own]), n[own].tobytes(), kinds.astype(np.uint8).tobytes()))

            descend(paths, np.full(len(paths), HOME), 0, lambda p, _: p in splits, leaf, prune=False)
            names = ["cell", "words", "counts", "kinds"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=names)

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROUTED:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return run


class Words:
    """The words of a cell, laid out for comparison of many pairs at once."""

    def __init__(self, words: list[bytes], least: int):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.paths = vectors(words)
        wide = min(WIDE, int(self.sizes.max()))
        self.ahead = np.zeros((len(words), wide), np.uint8)
        self.back = np.zeros((len(words), wide), np.uint8)
        for table, of in ((self.ahead, lambda w: w), (self.back, lambda w: w[::-1])):
            text = b"".join(of(w)[:wide].ljust(wide, b"\0") for w in words)
            table[:] = np.frombuffer(text, np.uint8).reshape(-1, wide)
        # One edit leaves the first or the last half of the shortest word alone.
        k = min(8, least // 2)
        weights = np.uint64(1) << np.arange(0, 8 * k, 8, dtype=np.uint64)
        self.first, self.last = ((t[:, :k] * weights).sum(axis=1, dtype=np.uint64) for t in (self.ahead, self.back))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of different words whether one inserted, deleted or replaced code point makes them equal."""
        more = self.paths[a] > self.paths[b]
        less = self.paths[a] < self.paths[b]
        right = (more.sum(axis=1) <= 1) & (less.sum(axis=1) <= 1) & (np.abs(self.sizes[a] - self.sizes[b]) <= 1)
        at = np.flatnonzero(right)
        long = np.maximum(self.sizes[a[at]], self.sizes[b[at]])
        for i in at[long > WIDE].tolist():
            right[i] = one_edit(self.words[a[i]], self.words[b[i]])
        at, long = at[long <= WIDE], long[long <= WIDE]
        wide = self.ahead.shape[1]
        same = []
        for table in (self.ahead, self.back):
            other = table[a[at]] != table[b[at]]
            same.append(np.where(other.any(axis=1), other.argmax(axis=1), wide))
        short = np.minimum(self.sizes[a[at]], self.sizes[b[at]])
        right[at] = np.minimum(same[0], short) + np.minimum(same[1], short) >= long - 1
        return right

    def pairs(self, kinds: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """All near pairs of a word of the cell with another one or with a search."""
        found = [(np.zeros(0, np.int64),) * 2]

        def leaf(_, own, kinds):
            home = own[kinds == HOME]
            both = np.concatenate([home, own[kinds != HOME]])
            step = max(1, AT_ONCE // len(both))
            for i in range(0, len(home), step):
                one = home[i : i + step]
                alike = self.first[one][:, None] == self.first[both]
                alike |= self.last[one][:, None] == self.last[both]
                alike[:, : len(home)] &= np.arange(len(home)) > np.arange(i, i + len(one))[:, None]
                a, b = np.nonzero(alike)
                for at in range(0, len(a), AT_ONCE // WIDE):
                    x, y = one[a[at : at + AT_ONCE // WIDE]], both[b[at : at + AT_ONCE // WIDE]]
                    near = self.near(x, y)
                    found.append((x[near], y[near]))

        descend(self.paths, kinds, level, lambda _, words: words > SMALL, leaf, prune=True)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced character makes two different words equal."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    ahead = np.append(x != y[: len(x)], True).argmax()
    back = np.append(x[::-1] != y[::-1][: len(x)], True).argmax()
    return bool(ahead + back >= len(b) - 1)


def _near_words(least: int):
    def run(rows: pa.Table) -> pa.Table:
        level = len(rows.column("cell")[0].as_py())
        words = b"\n".join(rows.column("words").to_pylist()).split(b"\n")
        n = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int64)
        kinds = np.frombuffer(b"".join(rows.column("kinds").to_pylist()), np.uint8).astype(np.int64)
        if (kinds == HOME).any():
            a, b = Words(words, least).pairs(kinds, level)
        else:
            a = b = np.zeros(0, np.int64)
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        own, other = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((rank[other], -n[other], own))
        own, at, count = np.unique(own[order], return_index=True, return_counts=True)
        best = other[order][at]
        text = lambda places: pa.array([words[i].decode("latin-1") for i in places.tolist()], pa.string())
        return pa.table({"word": text(own), "near": pa.array(count, pa.int64()), "less": pa.array(-n[best]), "form": text(best)})

    return run


def near_words(words: DataFrame, least: int) -> DataFrame:
    """``word, n_near, form, form_n`` for every one of ``words(word, n)`` that has near words.

    ``n_near`` counts them, ``form`` is the one of the largest count (ties: the smallest word).
    Words are distinct and of at least ``least`` code points.
    """
    words = stage(words.mapInArrow(_paths, "word string, n long, path binary"), "word-paths")
    sent = words.mapInArrow(_route(_splits(words)), "cell binary, words binary, counts binary, kinds binary")
    found = sent.groupBy("cell").applyInArrow(_near_words(least), "word string, near long, less long, form string")
    best = F.min(F.struct("less", "form")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
    )


def variants(words: DataFrame, least: int = 7, factor: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every one of ``words(word, n)``.

    A word's form is its near word of the largest count, if that is at least ``factor`` times the
    word's own; the root is the end of its forms. Words hold U+0000 to U+00FF without line ends,
    are distinct, not null and of at least ``least`` code points; a word of any length is compared
    whole; no words give no rows.
    """
    if factor < 2:
        raise ValueError("a form has to be more frequent than its word")
    settings(words.sparkSession)
    words = stage(words.select("word", "n"), "words")
    found = stage(near_words(words, least), "near-words")
    common = F.col("form_n") >= factor * F.col("n")
    full = words.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(common, F.col("form")).alias("form"),
        F.when(common, F.col("form_n")).alias("form_n"),
    )
    full = stage(full, "word-forms")
    # Counts grow with every step, so chains are short; each round doubles what it follows.
    roots = full.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stage(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        more = roots.where("next is not null").limit(1).count()
        roots = roots.drop("next")
        if not more:
            break
    return full.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
