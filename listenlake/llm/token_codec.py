"""Token files coded by a static range asymmetric numeral system (rANS).

A token table is a folder with two Parquet tables that Spark writes and reads:

``table``   symbol, frequency: one shared frequency table, scaled to sum to 2**SCALE_BITS.
``blocks``  one row per block, in ascending key order by ``first``: each block can be decoded alone.

Block bytes, all little-endian: the header ``HEADER``; then for each document its number of
ids (u8) ; then for each checkpoint the place in the word stream (u4) and the state of every
lane (u8); then the word stream (u4). Token t of a block belongs to lane ``t % lanes``; a step
decodes one token in every lane. Decoding can begin at any checkpoint, and each block carries
the CRC-32 of its coded bytes and of its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm.common import settings, slices, stage, tasks
from listenlake.llm.tokens import END_ID, default_path, memory
from listenlake.session import staging_path

MAGIC = b"RANS"
HEADER = struct.Struct("<4sHHIIIQQII")  # magic, version, scale bits, lanes, steps a checkpoint, documents, first id, ids, crc of body, crc of ids
SCALE_BITS = 20
LANES = 4096
CHECKPOINT_STEPS = 256
BLOCK_IDS = 1 << 20
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
WORD = np.uint64(32)
TEXT_BYTES = 4 << 20


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, np.int64)
    there = np.flatnonzero(counts)
    total = 1 << bits
    if len(there) > total:
        raise ValueError("more symbols than the scale can hold")
    out = np.zeros(len(counts), np.int64)
    if not len(there):
        return out
    own = np.maximum(1, (counts[there].astype(float) / counts[there].sum() * total).astype(np.int64))
    order = np.argsort(-own, kind="stable")
    missing = total - int(own.sum())
    if missing > 0:
        own[order[0]] += missing
    while missing < 0:  # take back from the most frequent, which lose least by it
        cut = np.minimum(own[order] - 1, np.maximum(1, own[order] >> 4))
        take = np.minimum(cut, np.maximum(0, -missing - (np.cumsum(cut) - cut)))
        own[order] -= take
        missing += int(take.sum())
    out[there] = own
    return out


class Coder:
    """Codes and decodes blocks under one frequency table."""

    def __init__(self, frequencies: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.freq = np.asarray(frequencies, np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray, doc_sizes: np.ndarray, first: int) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
        states = {}
        for s in range(steps - 1, -1, -1):
            own = ids[s * lanes : (s + 1) * lanes]
            x, f = state[: len(own)], self.freq[own]
            over = x >= f << np.uint64(63 - int(self.bits))
            words[s] = (x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            x = np.where(over, x >> WORD, x)
            q = x // f
            state[: len(own)] = (q << self.bits) + (x - q * f) + self.cum[own]
            if s % CHECKPOINT_STEPS == 0:
                states[s] = state.copy()
        places = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        body = [np.asarray(doc_sizes, "<u8").tobytes()]
        for s in sorted(states):
            body += [struct.pack("<I", int(places[s])), states[s].astype("<u8").tobytes()]
        body.append(np.concatenate([np.zeros(0, np.uint32), *words]).astype("<u4").tobytes())
        body = b"".join(body)
        head = (MAGIC, 1, int(self.bits), lanes, CHECKPOINT_STEPS, len(doc_sizes), first, n, zlib.crc32(body))
        return HEADER.pack(*head, zlib.crc32(np.asarray(ids, "<u4").tobytes())) + body

    def decode(self, block: bytes, checkpoint: int = 0, last: int | None = None):
        """(first id's place, document sizes, ids) of a block, or of the steps between two checkpoints."""
        head = HEADER.unpack_from(block)
        magic, _, _, lanes, every, n_docs, first, n, crc, ids_crc = head
        body = memoryview(block)[HEADER.size :]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        sizes = np.frombuffer(body, "<u8", n_docs).astype(np.int64)
        steps = -(-n // lanes)
        marks, at = -(-steps // every), 8 * n_docs
        width = 4 + 8 * lanes
        stream = np.frombuffer(body, "<u4", offset=at + marks * width).astype(np.uint64)
        if not n:
            return first, sizes, np.zeros(0, np.uint32)
        begin, end = checkpoint * every, min(steps, every * (marks if last is None else last))
        place = struct.unpack_from("<I", body, at + checkpoint * width)[0]
        state = np.frombuffer(body, "<u8", lanes, at + checkpoint * width + 4).astype(np.uint64)
        out = np.empty(min(n, end * lanes) - begin * lanes, np.uint32)
        for s in range(begin, end):
            count = min(lanes, n - s * lanes)
            x = state[:count]
            low = x & self.mask
            symbol = self.slot[low]
            x = self.freq[symbol] * (x >> self.bits) + low - self.cum[symbol]
            under = np.flatnonzero(x < LOW)
            x[under] = (x[under] << WORD) | stream[place : place + len(under)]
            place += len(under)
            state[:count] = x
            out[(s - begin) * lanes : (s - begin) * lanes + count] = symbol
        if begin == 0 and end == steps and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("ids do not match their checksum")
        return first, sizes, out


def _tokenize(key: str, text: str, path: str, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = memory(path).encode_with_end
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                ids, borders = encode([x.as_py() for x in part.column(text).cast(pa.binary())], end_id)
                ids = ids.astype(width)
                blobs = pa.array([ids[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), task, np.int64)),
                        pa.array(before + borders[:-1]),
                        part.column(key),
                        pa.array(np.diff(borders)),
                        blobs,
                    ],
                    names=["task", "before", key, "n_tokens", "ids"],
                )
                before += int(borders[-1])

    return run


def _count(width: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for blob in batch.column("ids"):
                counts += np.bincount(np.frombuffer(blob.as_buffer(), width), minlength=vocabulary)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["symbol", "n"])

    return run


def _blocks(key: str, width: str, frequencies: np.ndarray, bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        ids, sizes, keys, held, first = [], [], [], 0, 0

        def block():
            coded = coder.encode(np.concatenate(ids), np.array(sizes), first)
            return pa.RecordBatch.from_arrays(
                [pa.array([first]), pa.array([keys], pa.list_(kind)), pa.array([coded], pa.binary())],
                names=["first", "keys", "block"],
            )

        kind, next_ = pa.int64(), None
        for batch in batches:
            kind = batch.schema.field(key).type
            for task, before, name, n, blob in zip(*(batch.column(i) for i in range(5)), strict=True):
                at = bases[task.as_py()] + before.as_py()
                if ids and (at != next_ or held + n.as_py() > BLOCK_IDS):
                    yield block()
                    ids, sizes, keys, held = [], [], [], 0
                if not ids:
                    first = at
                ids.append(np.frombuffer(blob.as_buffer(), width))
                sizes.append(n.as_py())
                keys.append(name.as_py())
                held += n.as_py()
                next_ = at + n.as_py()
        if ids:
            yield block()

    return run


def write(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
) -> None:
    """Encode whole texts and write them as a token table at ``path``, in ascending key order.

    A null or empty text is the end id alone. Null keys come first, repeated keys follow one
    another; an empty table gives an empty token table; other columns are ignored. A document
    is never cut, so a block holds about BLOCK_IDS ids or one longer document.
    """
    spark = settings(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    vocabulary = memory(tokenizer).vocabulary
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    kind = docs.schema[key].dataType.simpleString()
    ordered = docs.select(key, text).repartitionByRange(tasks(spark), key).sortWithinPartitions(key)
    schema = f"task long, before long, `{key}` {kind}, n_tokens long, ids binary"
    encoded = stage(ordered.mapInArrow(_tokenize(key, text, tokenizer, end_id, width), schema), "token-ids")

    counted = encoded.select("ids").mapInArrow(_count(width, vocabulary), "symbol long, n long")
    counts = np.zeros(vocabulary, np.int64)
    for row in counted.groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # at most a row for each symbol
        counts[row["symbol"]] = row["n"]
    frequencies = scaled(counts)
    bases, total = {}, 0
    for row in encoded.groupBy("task").agg(F.sum("n_tokens").alias("n")).orderBy("task").collect():  # a row a task
        bases[row["task"]], total = total, total + row["n"]

    there = np.flatnonzero(frequencies)
    table = pa.table({"symbol": there, "frequency": frequencies[there]})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/table")
    blocks = encoded.mapInArrow(
        _blocks(key, width, frequencies, bases), f"first long, keys array<{kind}>, block binary"
    )
    # The blocks hardly compress any further.
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _documents(key: str, frequencies: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for keys, block in zip(batch.column("keys"), batch.column("block"), strict=True):
                first, sizes, ids = coder.decode(block.as_py())
                ends = np.cumsum(sizes)
                blobs = [ids[b - n : b].astype("<u4").tobytes() for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(first + ends - sizes), pa.array(sizes), pa.array(blobs, pa.binary())],
                    names=[key, "start", "n_tokens", "ids"],
                )

    return run


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """A token table's documents: ``key, start, n_tokens, ids`` (little-endian unsigned 32-bit)."""
    settings(spark)
    rows = spark.read.parquet(f"{path}/table").collect()  # at most a row for each symbol
    frequencies = np.zeros(max((r["symbol"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        frequencies[r["symbol"]] = r["frequency"]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # blocks are large rows
    return blocks.select("keys", "block").mapInArrow(
        _documents(key, frequencies), f"`{key}` {kind}, start long, n_tokens long, ids binary"
    )


def new_path(spark: SparkSession) -> str:
    """A fresh place for a token table below the shared folder."""
    return staging_path(spark, "token-table")
