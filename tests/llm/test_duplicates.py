"""Repeated passages, SimHash components, near copies and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

import edges
from listenlake.llm import decontam, induced, plans, simhash, suffix_dedup
from listenlake.llm.components import _state, components

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# Repeated passages


def covered(docs):
    """For each (key, bytes): which bytes a 50-byte string of a smaller key covers. A null key is the largest."""
    docs = [(suffix_dedup.NO_KEY if k is None else k, t) for k, t in docs]
    first = {}
    for k, t in docs:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], k), k)
    out = []
    for k, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < k:
                gone[i : i + 50] = True
        out.append(gone)
    return out


def by(table, column):
    return {x: table.filter(pc.equal(table.column(column), x)) for x in set(table.column(column).to_pylist())}


def steps(docs, chunks, bits):
    """All steps of the operator over tables, without Spark."""
    dealt = {}
    for k, t in docs:
        dealt.setdefault(hash((k, t)) % chunks, []).append((k, t))
    given = {
        c: pa.table({"chunk": [c] * len(v), "_key": [k for k, _ in v], "_text": pa.array([t for _, t in v], pa.binary())})
        for c, v in dealt.items()
    }
    none = suffix_dedup._replies([])
    grams = pa.concat_tables([suffix_dedup._grams(bits)(t) for t in given.values()])
    shared = pa.concat_tables([none, *(suffix_dedup._shared_grams(t) for t in by(grams, "shard").values())])
    told = by(shared, "chunk")
    found = pa.concat_tables([suffix_dedup._contexts(bits)(t, told.get(c, none)) for c, t in given.items()])
    owners = [suffix_dedup._owners(t) for t in by(found, "shard").values()]
    told = by(pa.concat_tables([shared, *owners]), "chunk")
    marks = {}
    for c, t in given.items():
        chunk = suffix_dedup.Chunk(t)
        gone = suffix_dedup._mark(chunk, told.get(c, none))
        for k, text, end in zip(chunk.names, chunk.texts, chunk.ends.tolist(), strict=True):
            marks[(k, text)] = gone[end - len(text) : end]
    return marks


@pytest.mark.parametrize("seed", range(25))
def test_marks_equal_brute_force(seed, monkeypatch):
    monkeypatch.setattr(induced, "SEGMENT", 300)
    draw = random.Random(seed)
    stock = [[b"a"], [b"a", b"b"], [b"the ", b"quick ", b"brown\x00\xff ", b"fox. "], [bytes([c]) for c in range(97, 123)]][seed % 4]
    pool = [b"".join(draw.choice(stock) for _ in range(draw.randint(5, 90))) for _ in range(4)]
    docs = []
    for k in range(draw.randint(1, 14)):
        parts = [draw.choice(pool) if draw.random() < 0.4 else b"".join(draw.choice(stock) for _ in range(draw.randint(0, 30))) for _ in range(6)]
        docs.append((k // draw.choice([1, 1, 2]), b"".join(parts)[draw.randint(0, 20) :]))
    docs += docs[:2] + [(1, b""), (2, b"x" * 49), (3, b"x" * 49)]
    marks = steps(docs, draw.randint(1, 4), draw.randint(0, 3))
    for (k, t), gone in zip(docs, covered(docs), strict=True):
        assert np.array_equal(marks[(k, t)], gone)


def test_least_owner_equals_brute_force():
    draw = np.random.default_rng(2)
    data = draw.integers(97, 99, 600).astype(np.uint8)
    data[300:500] = data[50:250]
    ends = np.array([280, 600])
    parts = [(a, f, l) for a, f, l, _ in induced.anchors(data, ends)]
    anchor, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows = induced.contexts(data, anchor, first, last)
    owner = draw.integers(0, 5, len(rows)).astype(np.int32)
    found = induced.least_owner(rows, owner)
    least = {}
    for a, f, l, o in zip(anchor, first, last, owner, strict=True):
        for p in range(f, l + 1):
            w = data[p : p + 50].tobytes()
            least[w] = min(least.get(w, 99), o)
    for i, (a, f, l) in enumerate(zip(anchor, first, last, strict=True)):
        for j in range(induced.REACH + 1):
            p = a - j
            assert found[i, j] == (least[data[p : p + 50].tobytes()] if f <= p <= l else -1)


def removal(rows):
    return sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], hashlib.sha256(bytes(r["kept"])).hexdigest(), len(r["spans"])) for r in rows
    )


def test_repeats_in_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    docs = [(k, (t or "").encode()) for k, t in edges.texts() if t is None or len(t) < 20_000]
    rows = edges.documents(spark, [(k, t) for k, t in edges.texts() if t is None or len(t) < 20_000])
    expected = []
    for (k, t), gone in zip(docs, covered(docs), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.pad(gone, 1).astype(np.int8)) == 1).sum())
        expected.append((k is None, k or 0, len(t), hashlib.sha256(kept).hexdigest(), runs))
    assert removal(suffix_dedup.remove_repeats(rows).collect()) == sorted(expected)
    assert suffix_dedup.remove_repeats(edges.empty(spark)).count() == 0


def test_repeats_query(spark):
    docs = [(k, t.encode()) for k, t in documents(spark).items()]
    got = {r["doc_id"]: r for r in plans.queries()["op3_suffix_dedup"](spark, SF).collect()}
    for (k, t), gone in zip(docs, covered(docs), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == int((np.diff(np.pad(gone, 1).astype(np.int8)) == 1).sum())


# SimHash


def plain_fingerprint(text, words):
    found = (text or "").encode().lower().split()
    runs = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {n: root(n) for n in nodes}


def test_simhash_query(spark):
    docs = documents(spark)
    fp = {k: plain_fingerprint(t, 3) for k, t in docs.items()}
    own = plain_components(sorted(docs), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in plans.queries()["op4_simhash"](spark, SF).collect()}
    assert got == {k: (f"{fp[k]:016x}", own[k]) for k in docs}


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_leaves_of_the_tree_lose_no_link(radius):
    draw = np.random.default_rng(radius)
    base = draw.integers(0, 2**64, 900, np.uint64)
    near = base[:400] ^ (np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64))
    tight = np.uint64(99) ^ (np.uint64(1) << draw.integers(0, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 700).astype(np.uint64))
    points = np.unique(np.concatenate([base, near, near ^ np.uint64(5), tight]))
    tree, leaves = simhash.grow(points[::2], 4, radius)
    assert leaves > 4
    found = simhash.Forest(len(points))

    def visit(node, home, query):
        if isinstance(node, int):
            a, b = simhash.leaf_links(home, query, radius)
            assert (np.bitwise_count(a ^ b) <= radius).all()
            found.join(np.searchsorted(points, a), np.searchsorted(points, b))
        else:
            inner, outer = simhash._sides(home, query, node.vantage, node.border, radius)
            visit(node.inner, *inner)
            visit(node.outer, *outer)

    visit(tree, points, points[:0])
    plain = simhash.Forest(len(points))
    plain.join(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius))
    assert np.array_equal(found.label, plain.label)


def test_simhash_edge_cases(spark):
    rows = edges.texts()
    got = simhash.groups(edges.documents(spark), words=3).collect()
    fps = [plain_fingerprint(t, 3) for _, t in rows]
    own = plain_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (k, _), f in zip(rows, fps, strict=True):
        if k is not None:
            least[own[f]] = min(least.get(own[f], k), k)
    expected = [(k, f, least.get(own[f])) for (k, _), f in zip(rows, fps, strict=True)]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got]) == order(expected)
    assert simhash.groups(edges.empty(spark)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges_ = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (201, 200)]
    rows = components(spark.createDataFrame(edges_, "a long, b long")).collect()
    label = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(label)
    assert all(label[i] == 0 for i in range(41)) and all(label[i] == 100 for i in range(100, 160)) and label[201] == label[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_state_of_very_many_links(spark):
    """The sum of as many 40-bit hashes is beyond a long."""
    many = spark.range(20_000_000).select(F.col("id").alias("b"), (F.col("id") + 1).alias("a"))
    assert _state(many)[0] == 20_000_000 and _state(many) == _state(many) != _state(many.where("a <> 7"))


# Near copies


def test_one_row_of_each_component_stays(spark):
    draw = random.Random(5)
    base = [edges.words(draw, 150) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:4]):
        own = t.split()
        for c in range(4):
            at = draw.randrange(10, 140)
            rows.append((100 + 10 * i + c, " ".join([*own[:at], f"word{c}", *own[at + 1 :]])))
    rows += [(3, base[3]), (50, base[5]), (60, None), (61, ""), (None, base[2]), (70, " "), (71, " \n")]
    rows += [(None, "only rows"), (None, "without a key"), (80, base[0] + " " + base[1]), (80, base[2] + " " + base[3])]
    prints = [simhash.fingerprint(simhash.shingle_hashes((t or "").encode(), 3)) for _, t in rows]
    own = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    best = {}
    for (k, t), fp in zip(rows, prints, strict=True):
        one = (k is None, k or 0, hashlib.sha256((t or "").encode()).hexdigest())
        best[own[fp]] = min(best.get(own[fp], one), one)
    got = simhash.representatives(edges.documents(spark, rows), words=3, radius=2)
    assert got.columns == edges.documents(spark, rows[:1]).columns
    kept = [(r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()]
    assert sorted(kept) == sorted(best.values())
    assert simhash.representatives(edges.empty(spark)).count() == 0


# Decontamination


def plain_hits(text, items, window):
    own = decontam.words_of(text)
    hit, found = np.zeros(len(own), bool), set()
    for item, value in items:
        w = decontam.words_of(value)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            phrase = w[a : a + window]
            for b in range(len(own) - len(phrase) + 1):
                if own[b : b + len(phrase)] == phrase:
                    hit[b : b + len(phrase)] = True
                    found.add(item)
    return hit, found


@pytest.mark.parametrize("seed", range(20))
def test_index_equals_brute_force(seed):
    draw = random.Random(seed)
    stock = [b"a", b"b", b"c", b"zz", b"q"][: draw.randint(2, 5)]
    items = [(i, b" ".join(draw.choice(stock[:3]) for _ in range(draw.randint(0, 7)))) for i in range(6)] + [(9, None)]
    docs = [b" ".join(draw.choice(stock) for _ in range(draw.randint(0, 60))) for _ in range(20)]
    docs += docs[:3] + [docs[0] * 3]
    phrases = decontam.Phrases.of(items, 4)
    ids = [np.array([phrases.ids.get(w, 0) for w in decontam.words_of(d)], np.int64) for d in docs]
    spans, found = decontam._spans(phrases, ids)
    for d, s, f in zip(docs, spans, found, strict=True):
        hit, expected = plain_hits(d, items, 4)
        mask = np.zeros(len(hit), bool)
        for a, b in s.tolist():
            mask[a:b] = True
        assert np.array_equal(mask, hit) and {i for p in f for i in phrases.items[p]} == expected


def test_suffix_order_is_complete():
    draw = np.random.default_rng(1)
    for n, k in ((1, 1), (50, 2), (300, 3), (400, 200)):
        text = np.append(draw.integers(1, k + 1, n), 0)
        plain = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        assert decontam.suffix_array(text).tolist() == plain


def test_decontamination_query_and_blocks(spark, monkeypatch):
    docs = documents(spark)
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in plans.queries()["op7_decontaminate"](spark, SF).collect()}
    windows = {}
    for item, value in items:
        w = decontam.words_of(value)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a : a + 13]), set()).add(item)
    sizes = {len(w) for w in windows}
    for k, t in docs.items():
        own = decontam.words_of(t.encode())
        hit, found = np.zeros(len(own), bool), set()
        for size in sizes:
            for b in range(len(own) - size + 1):
                if (w := tuple(own[b : b + size])) in windows:
                    hit[b : b + size] = True
                    found |= windows[w]
        names = ",".join(sorted(map(str, found)))
        r, n = got[k], int(hit.sum())
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(own), n, len(found))
        assert r["items_sha256"] == hashlib.sha256(names.encode()).hexdigest() and r["contaminated"] == (n > 0 and 20 * n >= len(own))
    whole = {r["doc_id"]: (r["spans"], sorted(r["items"])) for r in _find(spark).collect()}
    monkeypatch.setattr(decontam, "BENCHMARK_BYTES", 1500)
    assert {r["doc_id"]: (r["spans"], sorted(r["items"])) for r in _find(spark).collect()} == whole


def _find(spark):
    return decontam.find(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))


def test_decontamination_edge_cases(spark):
    rows = edges.texts()
    items = [(1, rows[1][1][20:220]), (2, None), (3, ""), (None, rows[0][1]), (4, "one"), (5, "TWO words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(edges.documents(spark), benchmark).collect()
    assert len(found) == len(rows)
    known = [(i, (t or "").encode()) for i, t in items if i is not None]
    expected = sorted((k is None, k or 0, int(h.sum()), sorted(f)) for (k, t) in rows for h, f in [plain_hits((t or "").encode(), known, 13)])
    hits = lambda r: sum(s["end"] - s["start"] for s in r["spans"])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, hits(r), sorted(r["items"])) for r in found) == expected
    kept = decontam.clean(edges.documents(spark), benchmark)
    assert kept.columns == edges.documents(spark).columns
    stays = 0
    for _, t in rows:
        hit, _ = plain_hits((t or "").encode(), known, 13)
        stays += not hit.any() or 20 * int(hit.sum()) < len(hit)
    assert kept.count() == stays
    assert decontam.find(edges.empty(spark), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(edges.documents(spark), none).where("size(spans) > 0").count() == 0


def test_items_without_a_name_are_searched(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    edges.documents(spark, [(1, item), (2, "other words"), (3, f"{item} z")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, item), (7, f"{item} z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in plans.queries()["op7_decontaminate"](spark, str(tmp_path)).collect()}
    assert {k: (r["n_hit"], r["n_items"], r["contaminated"]) for k, r in got.items()} == {1: (20, 2, True), 2: (0, 0, False), 3: (21, 2, True)}
    benchmark = spark.createDataFrame([(None, item)], "item_id long, text string")
    kept = decontam.clean(edges.documents(spark, [(1, item), (2, "other words")]), benchmark, nameless=True)
    assert [r["doc_id"] for r in kept.collect()] == [2]


def test_benchmark_is_held_block_by_block(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(13))) for i in range(9)]
    # Half an occurrence of each block's items: only hits of all blocks together reach one word in twenty.
    rows = [(1, " ".join([items[0][1], items[8][1], *["x"] * 480])), (2, " ".join([items[0][1], *["x"] * 480])), (3, "x")]
    docs, benchmark = edges.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    monkeypatch.setattr(decontam, "BENCHMARK_BYTES", 100)
    sizes, of = [], decontam.Phrases.of
    monkeypatch.setattr(decontam.Phrases, "of", lambda block, window: sizes.append(sum(len(t or b"") for _, t in block)) or of(block, window))
    written, stage = [], decontam.stage
    monkeypatch.setattr(decontam, "stage", lambda df, name: written.append(len(sizes)) or stage(df, name))
    assert sorted(r["doc_id"] for r in decontam.clean(docs, benchmark).collect()) == [2, 3]
    assert len(sizes) > 3 and max(sizes) < 200 and written == list(range(1, len(sizes)))
    sizes.clear(), written.clear()
    found = {r["doc_id"]: sorted(r["items"]) for r in decontam.find(docs, benchmark).collect()}
    assert found == {1: [0, 8], 2: [0], 3: []} and max(sizes) < 200 and written == list(range(1, len(sizes)))
