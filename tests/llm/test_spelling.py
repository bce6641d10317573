"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import edges
from listenlake.llm import plans, spelling

SF = "/root/testdata/sf0.001"


def plain_words(rows, least, occurrences, spoil=None):
    counts = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            for c in letters:
                yield word[:i] + c + word[i + 1 :]


def plain(words, factor=10):
    letters = set("".join(words))
    forms, near = {}, {}
    for w, n in words.items():
        own = {x for x in edits(w, letters) if x in words and x != w}
        near[w] = len(own)
        best = min(own, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= factor * n else None
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        yield w, forms[w], root, n, near[w], words.get(forms[w])


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: r[0])


def typos(draw, n):
    """Words with many variants, some of them of variants, and hot and very long ones."""
    letters = "abcdeinorst" + "éÀ×ÿ"
    words = Counter()
    for _ in range(n):
        word = "".join(draw.choice(letters) for _ in range(draw.randrange(7, 12)))
        words[word] += draw.choice([2, 3, 50, 1000, 20_000])
        for _ in range(draw.randrange(6)):
            word = draw.choice([x for x in edits(word, letters) if len(x) >= 7])
            words[word] += draw.choice([2, 5, 70, 900])
    for size in (63, 64, 65, 66, 300, 301, 5000):
        words["ab" * (size // 2) + "a" * (size % 2)] += 2
        words["ab" * (size // 2 - 1) + "ca" + "a" * (size % 2)] += 40
    return dict(words)


@pytest.mark.parametrize(("cell", "small"), [(1 << 16, 64), (300, 2), (20, 8)])
def test_equals_plain_comparison(spark, monkeypatch, cell, small):
    monkeypatch.setattr(spelling, "CELL", cell)  # splits are chosen on the driver
    words = typos(random.Random(cell), 250)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = order(plain(words))
    assert order(got.collect()) == expected
    assert any(r[1] not in (None, r[2]) for r in expected)  # chains of forms
    laid = spelling.Words([w.encode("latin-1") for w in words], 7)
    monkeypatch.setattr(spelling, "SMALL", small)
    a, b = laid.pairs(np.full(len(words), spelling.HOME), 0)
    assert len(a) == len(set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))) == sum(r[4] for r in expected) // 2


def test_many_words_of_one_vector():
    draw = random.Random(4)
    words = sorted({"".join(draw.sample("xyzqjwv", 7)) + tail for _ in range(900) for tail in ("", "é", "ß")})
    laid = spelling.Words([w.encode("latin-1") for w in words], 7)
    a, b = laid.pairs(np.full(len(words), spelling.HOME), 0)
    assert 2 * len(a) == sum(r[4] for r in plain(dict.fromkeys(words, 2)))


def test_words_of_texts(spark):
    rows = [*edges.texts(), (50, "Straße-STRASSE naïveté Ünïcode×÷ÿ " * 40), (51, "日本x y" + "abcdefg" * 900 + " éééééééé"), (51, "éééééééé")]
    for least, occurrences, spoil in ((7, 2, 31), (1, 1, None), (3, 2, 2)):
        got = spelling.vocabulary(edges.documents(spark, rows), least=least, occurrences=occurrences, spoil=spoil)
        assert dict(map(tuple, got.collect())) == plain_words(rows, least, occurrences, spoil)
    assert spelling.vocabulary(edges.empty(spark)).count() == 0
    assert spelling.variants(spelling.vocabulary(edges.empty(spark))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), factor=1)


def test_query_equals_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = plans.op12_spelling(spark, SF)
    assert order(got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == order(plain(plain_words(rows, 7, 2, 31)))
