"""Line dedup against plain counting."""

import random

import numpy as np
import pytest

import edges
from listenlake.llm import line_dedup


def plain_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def plain(rows, least, documents):
    holders = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(plain_key(line)) >= least:
                holders.setdefault(plain_key(line), set()).add(k)
    shared = {x: max(k for k in ks if k is not None) for x, ks in holders.items() if len(ks) >= documents}
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if plain_key(x) not in shared or shared[plain_key(x)] == k]
        yield k, len(lines), len(lines) - len(kept), "\n".join(kept)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def lines(draw):
    stock = [edges.words(draw, 6) + f" number {i} of them" for i in range(60)] + ["", " ", "short line", "x" * 19, "é" * 20, "é" * 19]
    rows = [(i, "\n".join(draw.choice(stock) for _ in range(draw.randrange(1, 9)))) for i in range(60)]
    rows += [(100 + i, f"A line of a third of all documents. \n own {i} line with enough characters") for i in range(40)]
    rows += [(200, "\x0b a Line of A third of all documents.\t\r"), (201, "A line of a third of all documents.\x85"), (3, stock[0])]
    rows += [(None, stock[0] + "\n" + stock[1]), (None, stock[1]), (None, None), (5, rows[5][1]), (5, rows[5][1])]
    return rows + [(300, "\n" * 5000 + stock[2]), (301, "\n".join(stock) * 300)]


@pytest.mark.parametrize(("least", "documents", "block"), [(20, 3, 1 << 18), (20, 3, 4), (1, 2, 16)])
def test_lines_shared_by_documents_go(spark, least, documents, block):
    rows = lines(random.Random(least + documents)) + edges.texts()
    got = line_dedup.drop_repeated(edges.documents(spark, rows), least=least, documents=documents, block=block)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert order(map(tuple, got.collect())) == order(plain(rows, least, documents))


def test_no_rows_and_no_texts(spark):
    assert line_dedup.drop_repeated(edges.empty(spark)).count() == 0
    got = line_dedup.drop_repeated(edges.documents(spark, [(1, None), (2, ""), (3, None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, ""), (2, 1, 0, ""), (3, 1, 0, "")]
    with pytest.raises(ValueError):
        line_dedup.drop_repeated(edges.empty(spark), documents=1)


def test_filters_miss_nothing_and_suspect_little():
    draw = np.random.default_rng(2)
    single, double = draw.integers(-(2**62), 2**62, 100_000), draw.integers(-(2**62), 2**62, 20_000)
    told = draw.integers(-(2**62), 2**62, 100)
    filters, no = line_dedup.Filters(), lambda x: np.zeros(len(x), bool)
    for part in np.array_split(draw.permutation(np.concatenate([single, double])), 7):
        filters.add(part, no(part))
    filters.add(double, no(double))
    filters.add(told, ~no(told))
    assert filters.suspects(double).all() and filters.suspects(told).all()
    assert filters.suspects(single).mean() < 0.03
    both = np.array([5, 5, 6])
    filters = line_dedup.Filters()
    filters.add(both, no(both))
    assert filters.suspects(np.array([5, 6, 7])).tolist() == [True, False, False]


def test_blocks_mark_what_several_rows_share():
    import pyarrow as pa

    d = [line_dedup._digest(x) for x in (b"a", b"b", b"c")]
    keys = pa.array([1, 2, 3], pa.int64())
    held = [(d[0] + d[1], 10, keys.slice(0, 1), 2), (d[1], 20, keys.slice(1, 1), 1), (d[1] + d[2], 30, keys.slice(2, 1), 2)]
    found = line_dedup._block(held, pa.int64()).to_pylist()
    states = [r["state"] for r in found]
    assert [r["key"] for r in found] == [1, 1, 2, 3, 3] and [r["place"] for r in found] == [10, 10, 20, 30, 30]
    assert states[0] == states[4] == line_dedup.ALONE
    assert sorted(states[1:4]) == [line_dedup.REPEATED, line_dedup.REPEATED, line_dedup.ANNOUNCED]
