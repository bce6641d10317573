"""Packing by power-of-two decomposition.

A document of n tokens is cut into whole sequences of the largest length and, for the rest,
one piece for each bit of its binary length, longest first. Every piece is a sequence by
itself, of a length that is a power of two: nothing is padded and no sequence crosses
documents. Sequences of one length form a bucket; numbers run through the buckets from the
longest to the shortest.

Texts are encoded once, in the tasks that read them, and nothing but a count per task and
length is gathered to number the sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import settings, slices, stage
from listenlake.llm.tokens import END_ID, default_path, memory

TEXT_BYTES = 4 << 20  # of text encoded for one Arrow batch of pieces


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; ``longest`` is a power of two."""
    found = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at = len(found) * longest
    rest, length = n - at, longest >> 1
    while rest:
        if rest >= length:
            found.append((at, length))
            at, rest = at + length, rest - length
        length >>= 1
    return found


def _pieces(key: str, text: str, path: str, longest: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = memory(path).encode_with_end
        task = TaskContext.get().partitionId()
        made = np.zeros(longest.bit_length(), np.int64)  # sequences of each length so far in this task
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                texts = [x.as_py() for x in part.column(text).cast(pa.binary())]
                ids, borders = encode(texts, end_id)
                sizes = np.diff(borders)
                cuts = [cut(int(n), longest) for n in sizes]
                owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
                start, length = np.array([p for c in cuts for p in c], np.int64).reshape(-1, 2).T
                data = ids.astype("<u4").tobytes()
                level = np.frexp(length.astype(float))[1] - 1
                nth = np.zeros(len(level), np.int64)
                for k in np.unique(level):
                    own = level == k
                    nth[own] = made[k] + np.arange(int(own.sum()))
                    made[k] += int(own.sum())
                # Pieces follow one another as their ids do, so one buffer holds them all.
                edges = 4 * np.append(0, np.cumsum(length))
                if edges[-1] >= 2**31:
                    blobs = pa.array([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                else:
                    offsets = pa.py_buffer(edges.astype(np.int32).tobytes())
                    blobs = pa.Array.from_buffers(pa.binary(), len(length), [None, offsets, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(owner)),
                        pa.array(start),
                        pa.array(length),
                        blobs,
                        pa.array(sizes[owner]),
                        pa.array(np.full(len(length), task, np.int64)),
                        pa.array(nth),
                    ],
                    names=[key, "start", "length", "ids", "doc_tokens", "_task", "_nth"],
                )

    return run


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    longest: int = 2048,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per sequence: ``key, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text is one sequence
    holding the end id; null and repeated keys are packed like any other row; very long texts
    are cut like others; an empty table gives no row; other columns are ignored.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    settings(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, _task long, _nth long"
    rows = docs.select(key, text)
    pieces = stage(rows.mapInArrow(_pieces(key, text, tokenizer or default_path(), longest, end_id), schema), "pieces")
    # A row for each task and length (at most twelve a task), never one for each piece. Numbers run on
    # from longer lengths, whose totals are twelve rows, and from earlier tasks of the same length.
    counts = pieces.groupBy("_task", "length").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.partitionBy(F.lit(0)).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("_begin"))
    firsts = counts.join(begins, "length").select(
        "_task", "length", (F.col("_begin") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("_first")
    )
    # As a written table its size is known when the join is planned: broadcast if small, and the pieces stay where they are.
    return pieces.join(stage(firsts, "first-numbers"), ["_task", "length"]).select(
        key,
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("_first") + F.col("_nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
