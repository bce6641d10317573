"""Removal of repeated passages by sampled suffixes and induced sorting, in shards.

A byte goes if a string of 50 bytes covers it that also starts in a document with a smaller
key. Texts are dealt out once, in chunks of a bounded size, and each later step meets its chunk
again through the same shuffle:

1. Each chunk's anchors (see ``induced``) are dealt to shards by their gram; shards tell each
   chunk which of its grams some other document has too. All other windows are unique.
2. Contexts of those grams, one of each kind from each chunk, meet in the gram's shard. Their
   suffixes are sorted by induction with common-prefix values, and each window learns the
   smallest key that holds it.
3. Each chunk marks its bytes.

Shuffles, which sort and spill to disk, take the place of priority queues on disk; only
contexts of repeated grams are ever sorted, never all suffixes of all texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm import induced
from listenlake.llm.common import settings

CHUNK_BYTES = 4 << 20  # of text in a chunk, about, or one longer document
GRAM_SHARD_BYTES = 32 << 20  # of all texts for each shard of grams, about
SHARD_BYTES = 4 << 20  # of all texts for each shard of contexts, about
NO_KEY = np.iinfo(np.int64).max  # null keys: larger than all others
REPLY = "chunk long, kind int, a binary, b binary"


class Chunk:
    """The documents of a chunk as one buffer."""

    def __init__(self, rows: pa.Table):
        texts = [x.as_py() or b"" for x in rows.column("_text")]
        keys = rows.column("_key").to_pylist()
        # Any order will do, as long as each step has the same.
        order = sorted(range(len(texts)), key=lambda i: (keys[i] is None, keys[i] or 0, texts[i]))
        self.texts = [texts[i] for i in order]
        self.names = [keys[i] for i in order]
        self.keys = np.array([NO_KEY if k is None else k for k in self.names], np.int64)
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the documents that hold some places."""
        return np.searchsorted(self.ends, at, side="right")


def _cut(shard: np.ndarray):
    """(shard, begin, end) of the runs of a sorted array."""
    if not len(shard):
        return []
    heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return zip(shard[heads].tolist(), heads.tolist(), np.append(heads[1:], len(shard)).tolist(), strict=True)


def _shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Shards of grams; the last bit, a flag, does not count. Anchors have small hashes, so these are mixed anew."""
    mixed = (hashes >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _grams(bits: int):
    """Step 1 in a chunk: its grams, each once; the last bit says if two of its documents share it."""

    def run(rows: pa.Table) -> pa.Table:
        chunk, found = Chunk(rows), []
        for anchor, _, _, h in induced.anchors(chunk.data, chunk.ends):
            key = chunk.keys[chunk.owner(anchor)]
            order = np.lexsort((key, h >> np.uint64(1)))
            h, key = h[order] >> np.uint64(1), key[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            other = np.zeros(len(h), bool)
            other[1:] = ~new[1:] & (key[1:] != key[:-1])
            heads = np.flatnonzero(new)
            tail = np.append(heads[1:], len(h)) - 1
            found.append((h[heads], key[heads], np.logical_or.reduceat(other, heads), key[tail]))
        if not found:
            return pa.table({"shard": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "grams": pa.array([], pa.binary())})
        h, low, flag, high = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, low, flag, high = h[order], low[order], flag[order], high[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        shared = np.logical_or.reduceat(flag, heads) | (np.minimum.reduceat(low, heads) != np.maximum.reduceat(high, heads))
        grams = (h[heads] << np.uint64(1)) | shared
        me = rows.column("chunk")[0].as_py()
        shard = _shard_of(grams, bits)
        by = np.argsort(shard, kind="stable")
        grams = grams[by]
        parts = [(s, grams[a:b].tobytes()) for s, a, b in _cut(shard[by])]
        return pa.table({"shard": [s for s, _ in parts], "chunk": [me] * len(parts), "grams": pa.array([g for _, g in parts], pa.binary())})

    return run


def _shared_grams(rows: pa.Table) -> pa.Table:
    """Step 1 in a shard: for each chunk, those of its grams that two documents have."""
    held = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("grams")]
    source = np.repeat(np.arange(len(held)), [len(x) for x in held])
    grams = np.concatenate(held)
    order = np.argsort(grams, kind="stable")
    h, source, flag = grams[order] >> np.uint64(1), source[order], (grams[order] & np.uint64(1)).astype(bool)
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(heads, len(h)))
    shared = np.repeat((sizes > 1) | np.logical_or.reduceat(flag, heads), sizes)
    h, source = h[shared], source[shared]
    by = np.argsort(source, kind="stable")
    h, source = h[by], source[by]
    chunks = rows.column("chunk").to_pylist()
    parts = [(chunks[s], h[a:b].tobytes()) for s, a, b in _cut(source)]
    return _replies([(c, 1, g, b"") for c, g in parts])


def _replies(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    chunk, kind, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table(
        {
            "chunk": pa.array(chunk, pa.int64()),
            "kind": pa.array(kind, pa.int32()),
            "a": pa.array(a, pa.binary()),
            "b": pa.array(b, pa.binary()),
        }
    )


def _occurrences(chunk: Chunk, replies: pa.Table):
    """Distinct contexts of shared grams in a chunk, and all their occurrences.

    Returns ``rows, grams`` of the contexts and ``which, anchor, first, last`` of the occurrences.
    """
    known = [np.frombuffer(a.as_buffer(), np.uint64) for k, a in zip(replies.column("kind").to_pylist(), replies.column("a"), strict=True) if k == 1]
    shared = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
    segments, rows, grams = [], [], []
    for anchor, first, last, h in induced.anchors(chunk.data, chunk.ends) if len(shared) else ():
        at = np.minimum(np.searchsorted(shared, h >> np.uint64(1)), len(shared) - 1)
        own = np.flatnonzero(shared[at] == h >> np.uint64(1))
        if not len(own):
            continue
        anchor, first, last, h = anchor[own], first[own], last[own], h[own]
        unique, index, which = np.unique(induced.contexts(chunk.data, anchor, first, last), return_index=True, return_inverse=True)
        segments.append((which, anchor, first, last))
        rows.append(unique)
        grams.append(h[index])
    if not rows:
        none = np.zeros(0, np.int64)
        return np.zeros(0, f"S{induced.ROW}"), np.zeros(0, np.uint64), none, none, none, none
    unique, index, inverse = np.unique(np.concatenate(rows), return_index=True, return_inverse=True)
    base = np.cumsum([0, *(len(r) for r in rows)])
    which = np.concatenate([inverse[base[i] + s[0]] for i, s in enumerate(segments)])
    return unique, np.concatenate(grams)[index], which, *(np.concatenate([s[i] for s in segments]) for i in (1, 2, 3))


def _least_keys(chunk: Chunk, n: int, which: np.ndarray, first: np.ndarray) -> np.ndarray:
    least = np.full(n, NO_KEY, np.int64)
    np.minimum.at(least, which, chunk.keys[chunk.owner(first)])
    return least


CONTEXTS = "shard long, chunk long, number binary, least binary, contexts binary"


def _contexts(bits: int):
    """Step 2 in a chunk: its contexts of shared grams, each once, with the least key that holds it."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"shard": [], "chunk": [], "number": [], "least": [], "contexts": []}
        if len(rows):
            chunk = Chunk(rows)
            contexts, grams, which, _, first, _ = _occurrences(chunk, replies)
            least = _least_keys(chunk, len(contexts), which, first)
            shard = _shard_of(grams, bits)
            order = np.argsort(shard, kind="stable")
            for s, a, b in _cut(shard[order]):
                own = order[a:b]
                out["shard"].append(s)
                out["chunk"].append(rows.column("chunk")[0].as_py())
                out["number"].append(own.astype(np.int32).tobytes())
                out["least"].append(zstandard.compress(least[own].tobytes(), 3))
                out["contexts"].append(zstandard.compress(contexts[own].tobytes(), 3))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return run


_RUN = np.dtype([("number", "<i4"), ("low", "u1"), ("high", "u1")])


def _joined(rows: pa.Table, column: str) -> bytes:
    return b"".join(zstandard.decompress(x.as_buffer()) for x in rows.column(column))


def _owners(rows: pa.Table) -> pa.Table:
    """Step 2 in a shard: for each chunk, runs of windows that a smaller key holds as well."""
    contexts = np.frombuffer(_joined(rows, "contexts"), f"S{induced.ROW}")
    number = np.frombuffer(b"".join(rows.column("number").to_pylist()), np.int32)
    least = np.frombuffer(_joined(rows, "least"), np.int64)
    source = np.repeat(np.arange(len(rows)), [len(x.as_buffer()) // 4 for x in rows.column("number")])
    keys, own = np.unique(least, return_inverse=True)
    found = induced.least_owner(contexts, own.astype(np.int32))
    found[found == own[:, None]] = -1  # no smaller key than the chunk knows itself
    edge = np.diff(np.pad(found >= 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    context, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    runs = np.empty(len(context), _RUN)
    runs["number"], runs["low"], runs["high"] = number[context], low, high - 1
    chunks = rows.column("chunk").to_pylist()
    parts = [(chunks[s], runs[a:b].tobytes()) for s, a, b in _cut(source[context])]
    return _replies([(c, 2, r, b"") for c, r in parts])


def _mark(chunk: Chunk, replies: pa.Table) -> np.ndarray:
    """Step 3: which bytes of the chunk go."""
    contexts, _, which, anchor, first, last = _occurrences(chunk, replies)
    delta = np.zeros(len(chunk.data) + 1, np.int32)
    if len(contexts):
        least = _least_keys(chunk, len(contexts), which, first)
        later = least[which] < chunk.keys[chunk.owner(first)]
        np.add.at(delta, first[later], 1)
        np.add.at(delta, last[later] + induced.LENGTH, -1)
        told = [np.frombuffer(a.as_buffer(), _RUN) for k, a in zip(replies.column("kind").to_pylist(), replies.column("a"), strict=True) if k == 2]
        runs = np.concatenate([np.zeros(0, _RUN), *told])
        runs = runs[np.argsort(runs["number"], kind="stable")]
        begin, end = (np.searchsorted(runs["number"], which, side=s) for s in ("left", "right"))
        count = end - begin
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        place = np.repeat(anchor, count)
        np.add.at(delta, place - runs["high"][at], 1)
        np.add.at(delta, place - runs["low"][at] + induced.LENGTH, -1)
    return np.cumsum(delta[:-1]) > 0


def _removed(key: str, kind: pa.DataType):
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        spans, kept, sizes, names = [], [], [], []
        if len(rows):
            chunk = Chunk(rows)
            gone = _mark(chunk, replies)
            names = chunk.names
            for text, end in zip(chunk.texts, chunk.ends.tolist(), strict=True):
                own = gone[end - len(text) : end]
                edge = np.flatnonzero(np.diff(np.pad(own, 1).astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                kept.append(np.frombuffer(text, np.uint8)[~own].tobytes() if len(edge) else text)
                sizes.append(len(text))
        return pa.table(
            {
                key: pa.array(names, kind),
                "n_bytes": pa.array(sizes, pa.int64()),
                "spans": pa.array(spans, span_type),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, spans, kept`` for every row of ``docs``.

    ``spans`` are the maximal removed stretches ``[start, end)`` in bytes of the UTF-8 text,
    ``kept`` the other bytes. Keys are whole numbers; rows of equal key do not remove each
    other's text, and a null key counts as larger than all others. Null and empty texts have
    no bytes; texts under 50 bytes stay whole; an empty table gives an empty result; other
    columns are ignored.
    """
    settings(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = math.ceil(total / CHUNK_BYTES) or 1
    gram_bits, bits = (max(0, math.ceil(total / size) - 1).bit_length() for size in (GRAM_SHARD_BYTES, SHARD_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    content = F.col(text).cast("binary")
    dealt = docs.select(
        F.pmod(F.xxhash64(key, F.crc32(content)), F.lit(chunks)).alias("chunk"),
        F.col(key).cast("long").alias("_key"),
        content.alias("_text"),
    )
    grams = dealt.groupBy("chunk").applyInArrow(_grams(gram_bits), "shard long, chunk long, grams binary")
    shared = grams.groupBy("shard").applyInArrow(_shared_grams, REPLY)
    found = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_contexts(bits), CONTEXTS)
    owners = found.groupBy("shard").applyInArrow(_owners, REPLY)
    told = shared.unionByName(owners)
    schema = f"`{key}` {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    arrow = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_removed(key, arrow), schema)
