"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of a bounded number of words. Over the words of a
shard it builds a suffix array, its Burrows-Wheeler transform, a wavelet tree for ranks and a
sample of suffix positions. All benchmark phrases are searched backwards at once; occurrences
are located by walking to the next sampled position, and their spans merged per document.

The alphabet is the benchmark's own words. Any other word ends a stretch: no phrase holds it,
so stretches shorter than the shortest phrase are left out of the index, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlake.llm.common import settings, slices, stage

WINDOW = 13
SHARD_BYTES = 8 << 20  # text of one shard, or one longer document
SHARD_ROWS = 2048
SAMPLE_STEP = 8
BENCHMARK_BYTES = 2 << 20  # of benchmark text sent to the tasks at once (some 85 bytes of driver memory each); a larger one goes in blocks


def _table() -> bytes:
    """Bytes of words stay (A-Z in lower case), all others become spaces."""
    keep = bytearray(b" " * 256)
    for i in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        keep[i] = i
    for i in range(0x41, 0x5B):
        keep[i] = i + 32
    return bytes(keep)


WORD_BYTES = _table()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, in order."""
    return (text or b"").translate(WORD_BYTES).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes still tied are sorted again."""
    n = len(text)
    bits = max(1, (int(text.max()) + 1).bit_length())
    step = max(1, 62 // bits)  # so many symbols fit one key to begin with
    rank = np.zeros(n, np.int64)
    for i in range(min(step, n)):
        rank[: n - i] |= (text[i:].astype(np.int64) + 1) << (bits * (step - 1 - i)) if step > 1 else text[i:]
    order = np.argsort(rank, kind="stable")
    # A suffix's rank is the place of its group's first member.
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, sizes)
    tied = np.repeat(sizes > 1, sizes)
    while tied.any():
        at = np.flatnonzero(tied)
        own = order[at]
        ahead = own + step
        next_ = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[own]
        by = np.lexsort((next_, group))
        own, next_, group = own[by], next_[by], group[by]
        order[at] = own
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        rank[own] = np.repeat(at[heads], sizes)
        tied[at] = np.repeat(sizes > 1, sizes)
        step *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin, end = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            b1, e1 = ones[begin], ones[end]
            begin = np.where(bit == 1, zeros + b1, begin - b1)
            end = np.where(bit == 1, zeros + e1, end - e1)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Backward search and location over one shard; symbols are 1 or more, 0 ends a stretch."""

    def __init__(self, text: np.ndarray, step: int = SAMPLE_STEP):
        text = np.append(text, 0)  # the last suffix is the smallest: ends are told apart by place
        order = suffix_array(_distinct_ends(text))
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        # All suffixes that begin with an end come first, so symbols are all that search needs.
        self.tree = WaveletTree(text[order - 1], max(1, int(text.max()).bit_length()))
        # Where a stretch begins is always sampled: no walk goes on into the stretch before it.
        marked = (order % step == 0) | (text[order - 1] == 0)
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.places = order[marked]
        self.marked = marked

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the index that begin with each phrase; phrases end at the matrix's right edge."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        top = len(self.first) - 1
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[live, -back]
            known = symbol < top
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: steps back to the next sampled place, then forward by as many."""
        found, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        while len(open_):
            here = self.marked[at]
            found[open_[here]] = self.places[self.marks[at[here]]] + steps[open_[here]]
            open_, at = open_[~here], at[~here]
            steps[open_] += 1
            symbol = self.tree.access(at)
            at = self.first[symbol] + self.tree.rank(symbol, at)
        return found


def _distinct_ends(text: np.ndarray) -> np.ndarray:
    """Ends get numbers of their own below all words, so that no suffix is compared beyond its stretch."""
    ends = np.flatnonzero(text == 0)
    out = text.astype(np.int64) + len(ends)
    # Of two ends the later is the smaller; the order is only a way to tell them apart.
    out[ends] = np.arange(len(ends))[::-1]
    return out


@dataclass
class Phrases:
    """A benchmark block: distinct windows as numbers of words, and the items of each."""

    ids: dict[bytes, int] = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    items: list[list] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[object, bytes | None]], window: int) -> Phrases:
        ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], dict] = {}
        for item, text in items:
            own = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[at : at + window]), {})[item] = None
        width = max(map(len, owners), default=1)
        rows = np.zeros((len(owners), width), np.int64)
        for i, phrase in enumerate(owners):
            rows[i, width - len(phrase) :] = phrase
        return cls(ids, rows, np.fromiter(map(len, owners), np.int64, len(owners)), [list(o) for o in owners.values()])


def _spans(phrases: Phrases, documents: list[np.ndarray]):
    """For each document: merged spans of its words that some phrase covers, and the phrases found."""
    spans, found = [np.zeros((0, 2), np.int64)] * len(documents), [()] * len(documents)
    if not len(phrases.rows):
        return spans, found
    shortest = int(phrases.lengths.min())
    text, places, owners = [], [], []
    for d, own in enumerate(documents):
        inside = own > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= shortest:
                text += [own[a:b], np.zeros(1, own.dtype)]
                places.append(a)
                owners.append((d, b - a))
    if not text:
        return spans, found
    text = np.concatenate(text).astype(np.int64)
    lengths = np.array([n for _, n in owners]) + 1
    starts = np.cumsum(lengths) - lengths
    index = FMIndex(text)
    low, high = index.search(phrases.rows, phrases.lengths)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(which))
    at = index.locate(rows)
    stretch = np.searchsorted(starts, at, side="right") - 1
    doc = np.array([d for d, _ in owners])[stretch]
    begin = at - starts[stretch] + np.array(places)[stretch]
    order = np.lexsort((begin, doc))
    doc, begin, end, which = doc[order], begin[order], (begin + phrases.lengths[which])[order], which[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for d, b, e, w in zip(*(np.split(x, cuts) for x in (doc, begin, end, which)), strict=True):
        if len(d):
            spans[d[0]] = merged(np.stack([b, e], axis=1))
            found[d[0]] = np.unique(w)
    return spans, found


CONTAMINATED = 20  # one word in so many hit makes a text contaminated


def _joined(earlier: pa.Array, spans: list[np.ndarray]) -> list[np.ndarray]:
    """Spans with those that earlier blocks of the benchmark have found."""
    pairs = ([(x["start"], x["end"]) for x in own] for own in earlier.to_pylist())
    return [merged(np.array([*own, *s.tolist()], np.int64).reshape(-1, 2)) for own, s in zip(pairs, spans, strict=True)]


def _span_array(spans: list[np.ndarray]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in spans], kind)


def _keep(phrases: Phrases, text: str, carried: str, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = phrases.ids.get
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                words = [words_of(x.as_py()) for x in part.column(text).cast(pa.binary())]
                documents = [np.fromiter((get(w, 0) for w in own), np.int64, len(own)) for own in words]
                spans, _ = _spans(phrases, documents)
                at = part.schema.get_field_index(carried)
                if at >= 0:
                    spans = _joined(part.column(at), spans)
                    part = part.remove_column(at)
                if not last:
                    yield part.append_column(carried, _span_array(spans))
                    continue
                hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
                kept = [not h or CONTAMINATED * h < len(w) for h, w in zip(hit, words, strict=True)]
                yield part.filter(pa.array(kept, pa.bool_()))

    return run


def _search(phrases: Phrases, key: str, text: str, item_type: pa.DataType, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = phrases.ids.get
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                documents = []
                for x in part.column(text).cast(pa.binary()):
                    own = words_of(x.as_py())
                    documents.append(np.fromiter((get(w, 0) for w in own), np.int64, len(own)))
                spans, found = _spans(phrases, documents)
                items = [list(dict.fromkeys(i for p in f for i in phrases.items[p])) for f in found]
                if "spans" in part.schema.names:  # what earlier blocks of the benchmark have found
                    spans = _joined(part.column("spans"), spans)
                    items = [list(dict.fromkeys([*a, *b])) for a, b in zip(part.column("items").to_pylist(), items, strict=True)]
                columns = {
                    key: part.column(key),
                    text: part.column(text),
                    "n_words": pa.array([len(d) for d in documents], pa.int64()),
                    "spans": _span_array(spans),
                    "items": pa.array(items, pa.list_(item_type)),
                }
                if last:
                    del columns[text]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching stretches as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)
    return np.stack([spans[head, 0], reach[last]], axis=1)


def _benchmark_blocks(
    benchmark: DataFrame, item: str, text: str, nameless: bool
) -> Iterator[tuple[list[tuple[object, bytes | None]], bool]]:
    """The benchmark in blocks of at most about BENCHMARK_BYTES, one at a time on the driver, and which is the last."""
    items = benchmark.select(item, text)
    rows = (items if nameless else items.where(F.col(item).isNotNull())).toLocalIterator()
    row, last = next(rows, None), False
    while not last:
        held, size = [], 0
        while row is not None and size < BENCHMARK_BYTES:
            value = row[1].encode() if row[1] is not None else None
            held.append((row[0], value))
            size += len(value or b"")
            row = next(rows, None)
        last = row is None
        yield held, last


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    nameless: bool = False,
) -> DataFrame:
    """``key, n_words, spans, items`` for every row of ``docs``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. ``spans``
    are the merged stretches ``[start, end)``, in words, that occurrences of benchmark windows
    cover; a window is ``window`` consecutive words of an item, or a whole shorter item.
    ``items`` are the items with a window in the row. Null and empty texts have no words, so
    nothing is found; items without words find nothing; items with a null id find nothing, or
    with ``nameless`` are searched like others and are one item, null; repeated rows are
    searched each; an empty benchmark finds nothing; other columns are ignored. The spans of
    each block of the benchmark are written before the next block is read.
    """
    spark = settings(docs.sparkSession)
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    found = f"n_words long, spans array<struct<start: long, end: long>>, items array<{item_kind}>"
    # Shards are filled from batches of more rows; a batch is cut by bytes before it is indexed.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SHARD_ROWS))
    rows = docs.select(key, text)
    for block, last in _benchmark_blocks(benchmark, item, item_text, nameless):  # a pass for each
        schema = f"`{key}` {kind}, {'' if last else f'`{text}` string, '}{found}"
        rows = rows.mapInArrow(_search(Phrases.of(block, window), key, text, item_type, last), schema)
        rows = rows if last else stage(rows, "benchmark-hits")
    return rows


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    nameless: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns and without a shuffle.

    A row is contaminated if occurrences of benchmark windows cover one of CONTAMINATED words
    or more. Rows without words stay. Items with a null id count with ``nameless`` only. Of a
    benchmark of more than one block the spans of each are written beside the rows before the
    next is read, so hits of all blocks count together.
    """
    spark = settings(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SHARD_ROWS))
    carried = "_hits"
    while carried in {c.lower() for c in docs.columns}:
        carried += "_"
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    marked = T.StructType([*docs.schema.fields, T.StructField(carried, T.ArrayType(span))])
    rows = docs
    for block, last in _benchmark_blocks(benchmark, item, item_text, nameless):
        keep = _keep(Phrases.of(block, window), text, carried, last)
        rows = rows.mapInArrow(keep, docs.schema) if last else stage(rows.mapInArrow(keep, marked), "benchmark-hits")
    return rows
