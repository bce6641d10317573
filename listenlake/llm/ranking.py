"""Ranked lexical search by dense matrix products over tiles.

The queries are taken in blocks of bounded size. A block's distinct terms are its vocabulary;
one pass over the documents counts all terms and keeps the counts of those in the vocabulary.
The second pass takes a tile of documents at a time, compacts the vocabulary to the terms the
tile holds, and multiplies tiles of (query, term) repeats by tiles of (term, document) impacts
in float64. A product is only taken where no sum can reach 2**53, so it is exact; a tile of
terms that could reach it is halved. Sums of tiles are 64-bit integers.

A task keeps the best documents of each query, by score and then by key, over all its tiles;
so a task passes on as many rows as the results have, however many documents tie.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import settings, stage

QUERIES = 1024  # of a block, at most
QUERY_BYTES = 1 << 20  # of a block's texts, about
TERMS = 2048  # of a tile
EXACT = 2.0**53  # below this float64 holds every integer
SCALE, FLOOR = 1_000_000_000, 25  # fixed values of the score

# ASCII letters and digits, and every byte of a code point beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, A-Z lower-cased, in order and with repeats."""
    return TERM.findall((text or b"").lower())


@dataclass
class Block:
    """Some queries: their names, the vocabulary, and (term, query, repeats) in order of terms."""

    names: list
    first: int  # number of the first query
    vocabulary: dict[bytes, int]
    starts: np.ndarray  # of a term's queries
    queries: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, bytes | None]], first: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        found = [
            (vocabulary.setdefault(term, len(vocabulary)), q, n)
            for q, (_, text) in enumerate(items)
            for term, n in Counter(terms(text)).items()
        ]
        term, query, repeats = np.array(sorted(found), np.int64).reshape(-1, 3).T
        starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        return cls([name for name, _ in items], first, vocabulary, starts, query, repeats)

    def tile(self, chosen: np.ndarray) -> np.ndarray:
        """Repeats of the chosen terms in every query: (query, chosen term)."""
        sizes = self.starts[chosen + 1] - self.starts[chosen]
        at = np.repeat(self.starts[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        out = np.zeros((len(self.names), len(chosen)), np.int64)
        out[self.queries[at], np.repeat(np.arange(len(chosen)), sizes)] = self.repeats[at]
        return out


def blocks(items: DataFrame, name: str, text: str) -> Iterator[Block]:
    """The queries in blocks, one at a time on the driver."""
    held, size, first = [], 0, 0
    for row in items.select(name, text).toLocalIterator():
        value = (row[1] or "").encode()
        if held and (len(held) == QUERIES or size + len(value) > QUERY_BYTES):
            yield Block.of(held, first)
            held, size, first = [], 0, first + len(held)
        held.append((row[0], value))
        size += len(value)
    if held:
        yield Block.of(held, first)


def _count(key: str, text: str, vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            sizes, ids, counts = [], [], []
            for value in batch.column(text).cast(pa.binary()):
                own = terms(value.as_py())
                found = [(at, n) for term, n in Counter(own).items() if (at := get(term)) is not None]
                sizes.append(len(own))
                pairs = np.array(found, "<i4").reshape(-1, 2)
                ids.append(pairs[:, 0].tobytes())
                counts.append(pairs[:, 1].tobytes())
            columns = [batch.column(key), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "terms", "counts"])

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


def _holders(n_terms: int):
    """For each term the documents of a task that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            held += np.bincount(_numbers(batch.column("terms")), minlength=n_terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "df"])

    return run


def product(repeats: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """The exact matrix product of integers that are not negative, by float64 where that is exact."""
    worst = repeats.astype(float) @ impacts.max(axis=1, initial=0).astype(float)
    if worst.max(initial=0) < EXACT / 2:  # the bound itself is rounded
        return (repeats.astype(float) @ impacts.astype(float)).astype(np.int64)
    if len(impacts) == 1:
        return repeats * impacts
    half = len(impacts) // 2
    return product(repeats[:, :half], impacts[:half]) + product(repeats[:, half:], impacts[half:])


def _first(queries: np.ndarray, scores: np.ndarray, keys: pa.Array, k: int) -> np.ndarray:
    """The rows that are among the first k of their query: higher scores, then smaller keys; nulls last."""
    rank = np.asarray(pc.rank(keys, "ascending", null_placement="at_end", tiebreaker="dense"))
    order = np.lexsort((rank, -scores, queries))
    own = queries[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
    return order[place < k]


def _best(block: Block, weights: np.ndarray, documents: int, length: int, k: int, name_type: pa.DataType):
    def tile_scores(batch: pa.RecordBatch) -> np.ndarray:
        sizes = np.array([len(x) // 4 for x in batch.column("terms").to_pylist()], np.int64)
        document = np.repeat(np.arange(batch.num_rows), sizes)
        term, tf = _numbers(batch.column("terms")), _numbers(batch.column("counts"))
        # Python's integers: the product of three may pass 64 bits.
        m = np.array([FLOOR + 75 * n * documents // length for n in batch.column("n").to_pylist()], np.int64)
        impact = weights[term] * (SCALE * tf // (1000 * tf + 8 * m[document]))
        held, column = np.unique(term, return_inverse=True)
        total = np.zeros((len(block.names), batch.num_rows), np.int64)
        for at in range(0, len(held), TERMS):
            inside = (column >= at) & (column < at + TERMS)
            impacts = np.zeros((len(held[at : at + TERMS]), batch.num_rows), np.int64)
            impacts[column[inside] - at, document[inside]] = impact[inside]
            total += product(block.tile(held[at : at + TERMS]), impacts)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = scores = np.zeros(0, np.int64)
        keys = None
        least = np.ones(len(block.names), np.int64)  # the score a document needs to be among the best
        for batch in batches:
            total = tile_scores(batch)
            q, d = np.nonzero(total >= least[:, None])
            own = batch.column("key").take(pa.array(d))
            keys = own if keys is None else pa.concat_arrays([keys, own])
            queries, scores = np.concatenate([queries, q]), np.concatenate([scores, total[q, d]])
            stays = _first(queries, scores, keys, k)
            queries, scores, keys = queries[stays], scores[stays], keys.take(pa.array(stays))
            full = np.bincount(queries, minlength=len(least)) == k
            lowest = np.full(len(least), np.iinfo(np.int64).max)
            np.minimum.at(lowest, queries, scores)
            least[full] = lowest[full]
        if keys is not None:
            names = pa.array([block.names[q] for q in queries.tolist()], name_type)
            columns = [pa.array(queries + block.first), names, keys, pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "name", "key", "score"])

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item, rank, key, score``: for each row of ``items`` the ``k`` documents of the highest score above 0.

    N counts the documents with a term, L all terms, n a document's terms, all with repeats; df the
    documents holding a term, tf its occurrences in one. A term weighs
    ``floor(1000 * ln((2N + 2) / (2df + 1)))``, and a document's score sums
    ``weight * (10**9 * tf div (1000 * tf + 8 * m))`` over the query's terms, repeats included,
    with ``m = 25 + 75 * n * N div L``. Equal scores go by key, null keys last; rows of one
    key are documents of their own, equal ones in any order; rows of one item are queries of
    their own. Null and empty texts have no terms: such queries find nothing, such documents are
    never found. Texts of any length are read whole; no documents or queries give no rows;
    other columns are ignored.
    """
    spark = settings(docs.sparkSession)
    key_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    found = spark.createDataFrame([], f"query long, name {item_kind}, key {key_kind}, score long")
    name_type = items.select(item).limit(0).toArrow().schema.field(0).type
    for block in blocks(items, item, item_text):
        rows = docs.select(key, text).mapInArrow(_count(key, text, block.vocabulary), f"key {key_kind}, n long, terms binary, counts binary")
        rows = stage(rows, "term-counts")
        documents, length = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not documents or not block.vocabulary:
            continue
        n_terms = len(block.vocabulary)
        # A row for each term of the block.
        held = rows.select("terms").mapInArrow(_holders(n_terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weights = np.zeros(n_terms, np.int64)
        for r in held.collect():
            weights[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
        best = _best(block, weights, documents, length, k, name_type)
        found = found.union(rows.mapInArrow(best, found.schema))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score")
