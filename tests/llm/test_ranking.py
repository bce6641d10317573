"""Ranked search against plain scoring in Python's integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import edges
from listenlake.llm import ranking


def plain_terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(rows, items, k):
    docs = [(key, Counter(plain_terms(t)), len(plain_terms(t))) for key, t in rows]
    count, length = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(term for _, own, _ in docs for term in own)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t, n in df.items()}
    for item, text in items:
        own, scores = Counter(plain_terms(text)), []
        for key, held, n in docs:
            m = 25 + 75 * n * count // length if length else 0
            score = sum(c * weight[t] * (10**9 * held[t] // (1000 * held[t] + 8 * m)) for t, c in own.items() if held[t])
            if score > 0:
                scores.append((-score, key is None, key or 0))
        yield from ((item, rank, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(scores)[:k], 1))


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or "", r[1], r[3]))


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "item_id string, text string, query string, rank int, score int")


def asked(draw):
    found = [(f"i{n}", edges.words(draw, 12)) for n in range(20)]
    found += [("none", None), ("empty", " - "), ("unknown", "zzzz qqqq"), ("many", "token " * 700 + "the 日本 NAÏVE x|y")]
    return found + [(None, "red house"), ("i0", "lazy"), ("hot", "shared12 words in many documents")]


@pytest.mark.parametrize(("k", "queries"), [(10, 1024), (1, 5), (200, 1024)])
def test_equals_plain_scores(spark, monkeypatch, k, queries):
    monkeypatch.setattr(ranking, "QUERIES", queries)  # blocks are cut on the driver
    draw = random.Random(k)
    rows = edges.texts() + [(100 + n, "Shared12 words, in many documents") for n in range(60)] + [(None, "shared12")]
    given = asked(draw)
    got = ranking.search(edges.documents(spark, rows), items(spark, given), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(got.collect()) == order(plain(rows, given, k))


def test_no_documents_queries_or_terms(spark):
    docs, some = edges.documents(spark), items(spark, [("a", "the red house")])
    assert ranking.search(edges.empty(spark), some).count() == 0
    assert ranking.search(docs, items(spark, [])).count() == 0
    assert ranking.search(docs, items(spark, [("a", None), ("b", "")])).count() == 0
    assert ranking.search(edges.documents(spark, [(1, None), (2, ""), (3, "...")]), some).count() == 0


def test_products_stay_exact_beyond_2_53():
    draw = np.random.default_rng(7)
    for top in (10, 2**20, 2**38):
        a, b = draw.integers(0, 2**14, (9, 33)), draw.integers(0, top, (33, 21))
        exact = a.astype(object) @ b.astype(object)
        assert (ranking.product(a, b) == exact).all()
    odd = np.array([[2**30 + 1]]), np.array([[2**30 + 3, 1]])
    assert ranking.product(*odd).tolist() == [[(2**30 + 1) * (2**30 + 3), 2**30 + 1]]
    assert ranking.product(np.zeros((3, 0), int), np.zeros((0, 2), int)).tolist() == [[0, 0]] * 3


def test_tiles_of_documents_keep_ties_in_order():
    import pyarrow as pa

    keys = pa.array([7, None, 3, 5, 3, 9])
    chosen = ranking._first(np.array([0, 0, 0, 1, 0, 1]), np.array([4, 4, 4, 2, 1, 6]), keys, 2)
    assert chosen.tolist() == [2, 0, 5, 3]
