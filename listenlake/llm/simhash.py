"""SimHash near-duplicates by vantage-point trees.

Distinct fingerprints are partitioned by their Hamming distance to vantage points. The upper
tree is fitted on a bounded sample (SAMPLE fingerprints) and every fingerprint is routed
through it: to one home leaf, and as a query to each further leaf that the triangle
inequality cannot exclude. A pair within the radius so meets in the home leaf of one of the
two. Leaves continue the tree in memory and compare what is left bit by bit; they return a
spanning forest of their links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import settings, stage
from listenlake.llm.components import components

SEED = 42
SAMPLE = 1 << 14  # fingerprints the upper tree is fitted on, at most
LEAF = 8192  # fingerprints of a leaf of the upper tree, about
SMALL = 512  # fingerprints of a leaf in memory
CELLS = 1 << 22  # pairs compared at once
ROUTED = 1 << 18  # fingerprints routed at once


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` lower-cased words, repeats included; of all words if there are fewer."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(found))
    last = len(found) - width + 1
    digest = xxhash.xxh64_intdigest
    runs = zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in runs), np.uint64, last)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where it is in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(carried: list[str], text: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            own = np.array([fingerprint(shingle_hashes(x.as_py(), words)) for x in texts], np.uint64)
            columns = [*(batch.column(c) for c in carried), pa.array(own.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "fp"])

    return run


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, also: tuple[str, ...] = ()
) -> DataFrame:
    """``key, *also, fp`` for every row: the SimHash of its word shingles as a signed long.

    Null and empty texts have fingerprint 0. Only A-Z are lower-cased; words end at ASCII white space.
    Texts of any length are hashed whole, a bounded number of shingles at a time.
    """
    settings(docs.sparkSession)
    carried = [key, *also]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*carried, text).mapInArrow(_fingerprints(carried, text, words), f"{schema}, fp long")


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point and the inner side's largest distance; None where no split helps."""
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, 4).astype(int)]:
        d = np.bincount(_distance(points, vantage), minlength=65)
        inner = np.cumsum(d)
        for border in range(65):
            if 0 < inner[border] < len(points):
                band = inner[border] - (inner[border - radius] if border >= radius else 0)
                load = max(inner[border], len(points) - inner[border] + band)
                if best is None or load < best[0]:
                    best = load, vantage, border
    if best is None or best[0] > 0.9 * len(points):
        return None
    return best[1], best[2]


@dataclass
class Node:
    vantage: np.uint64
    border: int
    inner: Node | int
    outer: Node | int


def grow(sample: np.ndarray, depth: int, radius: int) -> tuple[Node | int, int]:
    """The upper tree of a sample, at most ``depth`` deep, and its number of leaves."""
    count = 0

    def node(points: np.ndarray, left: int) -> Node | int:
        nonlocal count
        split = _split(points, radius) if left and len(points) >= 32 else None
        if split is None:
            count += 1
            return count - 1
        inner = _distance(points, split[0]) <= split[1]
        return Node(*split, node(points[inner], left - 1), node(points[~inner], left - 1))

    return node(sample, depth), count


def _sides(home, query, vantage, border, radius):
    """(home, query) of the inner and of the outer side. Home pairs cross the border by an inner query."""
    d, e = _distance(home, vantage), _distance(query, vantage)
    inner = home[d <= border], query[e <= border + radius]
    near = home[(d <= border) & (d > border - radius)]
    outer = home[d > border], np.concatenate([near, query[e > border - radius]])
    return inner, outer


def _route(tree, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def visit(node, home, query):
            if not len(home) and not len(query):
                return
            if isinstance(node, int):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node]), pa.array([home.tobytes()], pa.binary()), pa.array([query.tobytes()], pa.binary())],
                    names=["leaf", "home", "query"],
                )
                return
            inner, outer = _sides(home, query, node.vantage, node.border, radius)
            yield from visit(node.inner, *inner)
            yield from visit(node.outer, *outer)

        held, n = [], 0
        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= ROUTED:
                yield from visit(tree, np.concatenate(held), np.zeros(0, np.uint64))
                held, n = [], 0
        if held:
            yield from visit(tree, np.concatenate(held), np.zeros(0, np.uint64))

    return run


class Forest:
    """Labels of points that links have joined so far, and the links that joined them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.used: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray):
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            # Each root is hung below one smaller root, by one of its links.
            by = np.lexsort((low, high))
            first = by[np.concatenate([[True], high[by][1:] != high[by][:-1]])] if len(by) else by
            self.label[high[first]] = low[first]
            self.used.append((a[first], b[first]))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest made of given links."""
        none = np.zeros(0, np.int64)
        a, b = zip(*self.used, strict=True) if self.used else ((), ())
        return np.concatenate([none, *a]), np.concatenate([none, *b])


def leaf_links(home: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` among home points and from queries to them."""
    points = np.unique(np.concatenate([home, query]))
    forest = Forest(len(points))

    def compare(home, query):
        both = np.concatenate([home, query])
        step = max(1, CELLS // max(1, len(both)))
        at_home, at_both = np.searchsorted(points, home), np.searchsorted(points, both)
        for i in range(0, len(home), step):
            near = np.bitwise_count(home[i : i + step, None] ^ both[None, i:]) <= radius
            a, b = np.nonzero(near)
            forest.join(at_home[i + a], at_both[i + b])

    stack = [(home, query)]
    while stack:
        home, query = stack.pop()
        split = _split(home, radius) if len(home) > SMALL else None
        if split is None:
            if len(home):
                compare(home, query)
        else:
            stack += _sides(home, query, *split, radius)
    a, b = forest.links()
    return points[a], points[b]


def _leaf(radius: int):
    def run(rows: pa.Table) -> pa.Table:
        home, query = (
            np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(c)]) for c in ("home", "query")
        )
        a, b = leaf_links(home, query, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def links(points: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that join all distinct ``fp`` within ``radius`` bits, perhaps repeated.

    Every returned link is such a pair, and every such pair is connected by returned links.
    """
    n = points.count()
    sample = points.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()  # bounded by SAMPLE
    depth = max(0, (n // LEAF).bit_length())
    tree, _ = grow(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), depth, radius)
    routed = points.mapInArrow(_route(tree, radius), "leaf long, home binary, query binary")
    return routed.groupBy("leaf").applyInArrow(_leaf(radius), "a long, b long")


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, radius: int = 2
) -> DataFrame:
    """``key, fp, component_id`` for every row of ``docs``.

    Rows are linked when their fingerprints differ in at most ``radius`` bits; ``component_id``
    is the smallest key reachable over links (rows with a null key belong to a component but
    do not name one; it is null if no other row does). Repeated rows, null and empty texts are
    linked like any others; an empty table gives an empty result; other columns are ignored.
    """
    marked = stage(fingerprints(docs, key, text, words), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    named = _rooted(distinct, radius)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stage(named.join(smallest, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(by_fp, "fp").select(key, "fp", "component_id")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints with the smallest fingerprint of their component as ``root``."""
    roots = components(links(distinct.select("fp"), radius), "fingerprint-links")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, radius: int = 2
) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with all columns.

    Components are those of ``groups``. The row of the smallest key stays; null keys come last;
    rows of one key go by the SHA-256 of their text; of repeated rows one stays. Null and empty
    texts have fingerprint 0 and are one component with any other text of it; long texts are
    hashed whole; an empty table gives an empty result.
    Keys, hashes and fingerprints are all that is shuffled to choose; texts move once, at the end.
    """
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    slim = docs.select(F.col(key).alias("_key"), sha.alias("_sha"), F.col(text).alias("_text"))
    marked = fingerprints(slim, "_key", "_text", words, ("_sha",))
    best = F.min(F.struct(F.col("_key").isNull().alias("last"), "_key", "_sha")).alias("best")
    distinct = stage(marked.groupBy("fp").agg(best), "distinct-fingerprints")
    stays = _rooted(distinct, radius).groupBy("root").agg(F.min("best").alias("best"))
    stays = stays.select(F.col("best._sha").alias("_stays"), F.col("best._key").alias("_stays_key"))
    given = docs.withColumn("_sha", sha)
    same = (F.col("_sha") == F.col("_stays")) & F.col(key).eqNullSafe(F.col("_stays_key"))
    return given.join(stays, same, "left_semi").dropDuplicates(["_sha", key]).drop("_sha")
