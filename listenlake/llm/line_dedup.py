"""Line dedup by two Bloom filters, one for lines seen once and one for lines seen twice.

Every line gets a 128-bit digest of its key. The digests' space is cut into segments, whose
number grows with the lines, and each segment has a pair of filters of a fixed size. A task
sends each of its digests to a segment once. There the first filter takes what is new; what
the first already holds goes into the second. A digest in the second filter may be repeated,
all others are certainly not. Only these suspects are shuffled again, to count their documents
exactly and to choose the one that keeps its lines; texts move once, to the lines they lose.

A line that a task meets in several documents needs no filter: its digest is announced as
repeated, once, and its documents are suspects at once. So a line that a third of all documents
share reaches its segment once a block of lines, not once a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import settings, slices, stage

SPACE = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 17  # digests of a segment, about
FILTER_BITS = 21  # a filter has 2**21 places, 16 a digest, and a digest three of them
BLOCK = 1 << 18  # lines a task holds at once
TEXT_BYTES = 8 << 20  # of text worked on at once
ALONE, REPEATED, ANNOUNCED = range(3)  # in its block: in one row; in several; the first of several


def line_keys(text: bytes | None, least: int) -> list[bytes | None]:
    """For every line its key (stripped, A-Z lower-cased); None if that has under ``least`` code points."""
    keys = (line.strip(SPACE).lower() for line in (text or b"").split(b"\n"))
    # A code point takes one to four bytes, so most keys need no decoding.
    return [k if len(k) >= 4 * least or (len(k) >= least and len(k.decode()) >= least) else None for k in keys]


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _block(held: list, kind: pa.DataType) -> pa.RecordBatch:
    digests, places, keys, counts = zip(*held, strict=True)
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    order = np.lexsort((halves[:, 0], halves[:, 1]))
    own = halves[order]
    head = np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])
    group = np.cumsum(head) - 1
    several = np.bincount(group)[group] > 1
    state = np.empty(len(own), np.int32)
    state[order] = np.where(several, np.where(head, ANNOUNCED, REPEATED), ALONE)
    keys = pa.chunked_array(keys).combine_chunks().cast(kind).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
    columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.repeat(np.array(places), counts)), keys, pa.array(state)]
    return pa.RecordBatch.from_arrays(columns, names=["high", "low", "place", "key", "state"])


def _digests(key: str, text: str, least: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field(key).type
            places = batch.column("_place").to_pylist()
            for i, value in enumerate(batch.column(text).cast(pa.binary())):
                own = {_digest(k) for k in line_keys(value.as_py(), least) if k is not None}
                if own:
                    held.append((b"".join(own), places[i], batch.column(key).slice(i, 1), len(own)))
                    n += len(own)
                if n >= block:
                    yield _block(held, kind)
                    held, n = [], 0
        if held:
            yield _block(held, kind)

    return run


def _positions(low: np.ndarray) -> np.ndarray:
    shifts = np.arange(0, 3 * FILTER_BITS, FILTER_BITS, dtype=np.uint64)
    return ((low.view(np.uint64)[:, None] >> shifts) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


class Filters:
    """The two filters of a segment; both may hold too much, neither ever too little."""

    def __init__(self):
        self.once = np.zeros(1 << FILTER_BITS, bool)
        self.twice = np.zeros(1 << FILTER_BITS, bool)

    def add(self, low: np.ndarray, repeated: np.ndarray):
        """``low``: halves of digests; ``repeated``: those a task has already met in several rows."""
        low, at, counts = np.unique(low, return_inverse=True, return_counts=True)
        places = _positions(low)
        again = (counts > 1) | self.once[places].all(axis=1)
        again[at[repeated]] = True
        self.twice[places[again]] = True
        self.once[places] = True

    def suspects(self, low: np.ndarray) -> np.ndarray:
        return self.twice[_positions(low)].all(axis=1)


def _suspects(rows: pa.Table) -> pa.Table:
    filters = Filters()
    for part in rows.to_batches(max_chunksize=1 << 14):
        filters.add(part.column("low").to_numpy(), part.column("state").to_numpy() == ANNOUNCED)
    rows = rows.filter(pc.equal(rows.column("state"), ALONE))
    return rows.filter(pa.array(filters.suspects(rows.column("low").to_numpy()))).select(["high", "low", "place", "key"])


def repeated_lines(docs: DataFrame, key: str, text: str, least: int, documents: int, block: int = BLOCK) -> DataFrame:
    """``place, key, lost``: the digests of the lines a row loses, for rows that lose any.

    ``place`` is a hash of a row's key and text, so equal rows share one result.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(key, text, F.xxhash64(key, text).alias("_place"))
    schema = f"high long, low long, place long, key {kind}"
    lines = stage(given.mapInArrow(_digests(key, text, least, block), f"{schema}, state int"), "line-digests")
    sent = lines.where(F.col("state") != REPEATED)
    segments = 1 << (sent.count() // SEGMENT).bit_length()
    by_segment = sent.withColumn("segment", F.pmod("high", F.lit(segments)))
    found = stage(by_segment.groupBy("segment").applyInArrow(_suspects, schema), "suspect-lines")
    suspects = found.union(lines.where(F.col("state") != ALONE).drop("state"))
    # Exact: documents are counted by digest, and the largest keeps its lines.
    counted = suspects.select("high", "low", "key").distinct().groupBy("high", "low")
    shared = counted.agg(F.count("*").alias("n"), F.max("key").alias("keeper")).where(F.col("n") >= documents)
    shared = stage(shared.drop("n"), "shared-lines")
    lost = suspects.join(shared, ["high", "low"]).where(~F.col("key").eqNullSafe(F.col("keeper")))
    return stage(lost.groupBy("place", "key").agg(F.collect_set(F.struct("high", "low")).alias("lost")), "lost-lines")


def _without(key: str, text: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                lost = part.column("lost")
                halves = lost.flatten()
                digests = np.stack([halves.field(0).to_numpy(), halves.field(1).to_numpy()], axis=1).tobytes()
                edges = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lost])]) * 16
                kept, n_lines, n_dropped = [], [], []
                for value, a, b in zip(part.column(text).cast(pa.binary()), edges[:-1], edges[1:], strict=True):
                    value = value.as_py() or b""
                    lines = n = value.count(b"\n") + 1
                    if b > a:
                        own = {digests[i : i + 16] for i in range(a, b, 16)}
                        keys = line_keys(value, least)
                        stays = [k is None or _digest(k) not in own for k in keys]
                        value = b"\n".join(x for x, s in zip(value.split(b"\n"), stays, strict=True) if s)
                        lines = sum(stays)
                    kept.append(value)
                    n_lines.append(n)
                    n_dropped.append(n - lines)
                kept = pa.array(kept, pa.binary()).cast(pa.string())
                columns = [part.column(key), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_lines", "n_dropped", "kept"])

    return run


def drop_repeated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3, block: int = BLOCK
) -> DataFrame:
    """``key, n_lines, n_dropped, kept`` for every row: its text without lines that other documents hold.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least ``least`` code points in at least ``documents`` documents lose all their lines except
    in the largest key's document. Rows of one key are one document, and all of them keep its
    lines; rows without a key are one document, smaller than any other. A null or empty text is
    one empty line; a text whose lines all go is empty; long texts are split whole; an empty
    table gives no row; other columns are ignored.

    ``block`` is the number of lines a task holds at once; it changes no result.
    Equal keys are told by a 128-bit BLAKE2b digest, taken as exact.
    """
    if documents < 2:
        raise ValueError("a line is repeated in two documents at least")
    settings(docs.sparkSession)
    lost = repeated_lines(docs, key, text, least, documents, block).withColumnRenamed("key", "_key")
    given = docs.select(key, text, F.xxhash64(key, text).alias("_place"))
    same = (F.col("_place") == F.col("place")) & F.col(key).eqNullSafe(F.col("_key"))
    rows = given.join(lost, same, "left").select(key, text, "lost")
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(_without(key, text, least), f"`{key}` {kind}, n_lines long, n_dropped long, kept string")
