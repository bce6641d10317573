"""Interleaved shards, packed sequences and token files against plain computations."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import edges
from listenlake.llm import packing, plans, sharding, token_codec, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_differ_by_one_row_and_follow_the_mixture(spark):
    docs = edges.documents(spark)
    rows = sharding.interleave(docs, 4).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == set(docs.columns)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for source, n in Counter(r["source"] for r in rows).items():
        own = Counter(r["shard"] for r in rows if r["source"] == source)
        assert all(abs(own[s] - n / 4) <= 2 for s in range(4))
    assert sharding.interleave(edges.empty(spark), 4).count() == 0


def test_shards_equal_a_plain_ranking(spark):
    rows = plans.queries()["op1_interleave"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keys = {r["doc_id"]: (r["k"], r["source"]) for r in docs.select("doc_id", "source", sharding.shuffle_key(17, "doc_id").alias("k")).collect()}
    by_source = {}
    for i, (k, s) in keys.items():
        by_source.setdefault(s, []).append((k, i))
    at = [((2 * r + 1) / (2 * len(own)), k, i) for own in by_source.values() for r, (k, i) in enumerate(sorted(own))]
    n = len(at)
    expected = {}
    for place, (_, _, i) in enumerate(sorted(at)):
        shard = place * 40 // n
        expected[i] = (shard, place - -(-shard * n // 40))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == expected
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        own = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(own) + 16, zlib.crc32(own), "rows", None)


def test_mixture_holds_with_a_hot_source(spark):
    rows = [(i, "t") for i in range(900)]
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 9}") for i, _ in rows], "doc_id long, source string")
    found = sharding.interleave(docs, 10).groupBy("shard", "source").count().collect()
    assert all(abs(r["count"] - 60) <= 1 for r in found if r["source"] == "hot") and len(found) == 40


@given(st.lists(st.text(alphabet="ab Éß.,'|<>\n\t1İΣǅ日́", max_size=60), max_size=6), st.integers(4, 12))
@settings(max_examples=60, deadline=None)
def test_ids_equal_the_library(texts, bits):
    memory = _memory()
    memory.bits = bits  # so small that it often starts anew
    memory._forget()
    ids, borders = memory.encode([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert ids[borders[i] : borders[i + 1]].tolist() == memory.tokenizer.encode(text, add_special_tokens=False).ids


def _memory(made=[]):
    if not made:
        made.append(tokens.RunMemory(tokens.default_path()))
    return made[0]


def test_special_tokens_and_long_texts_equal_the_library(tokenizer):
    texts = ["a<|endoftext|>b <|startoftext|>", "x " * 600_000 + "end", "y" * 700_000, "'s 't don't", "ÀÉ×÷ ß ÿ"]
    ids, borders = tokens.RunMemory(tokens.default_path()).encode([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert ids[borders[i] : borders[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 7, 2047, 2048, 2049, 5000, 4096])
def test_cuts_are_powers_of_two(n):
    cuts = packing.cut(n, 2048)
    assert all(length & (length - 1) == 0 and length <= 2048 for _, length in cuts)
    assert [a for a, _ in cuts] == [0, *np.cumsum([b for _, b in cuts])[:-1]] and sum(b for _, b in cuts) == n
    assert [b for _, b in cuts] == sorted((b for _, b in cuts), reverse=True)


def test_packing_covers_each_id_once(spark, tokenizer):
    docs = edges.documents(spark)
    rows = packing.pack(docs, longest=64).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True) and all(r["offset"] == 0 for r in rows)
    given_ids = Counter((i, tuple(encoded(tokenizer, t))) for i, t in edges.texts())
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    for (i, ids), n in given_ids.items():
        if given_ids[(i, ids)] == n and sum(len(o[1]) == len(ids) for o in given_ids if o[0] == i) == 1:
            for at, length in packing.cut(len(ids), 64):
                assert pieces[(i, len(ids), at)] == [list(ids[at : at + length])] * n
    assert packing.pack(edges.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, longest=100)


def test_pack_query_equals_plain_encoding(spark, tokenizer):
    rows = plans.queries()["op10_pack"](spark, SF).collect()
    expected = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = encoded(tokenizer, r["text"])
        for at, length in packing.cut(len(ids), 2048):
            expected[(r["doc_id"], at)] = (length, crc(ids[at : at + length]), len(ids), 0)
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in rows} == expected
    assert len({r["sequence_id"] for r in rows}) == len(rows) == len(expected)


@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip_from_every_checkpoint(ids, seed):
    ids = np.array(ids * (seed + 1), np.uint32)
    coder = token_codec.Coder(token_codec.scaled(np.bincount(ids, minlength=50), 12), 12)
    block = coder.encode(ids, np.array([len(ids)]), 7)
    first, sizes, back = coder.decode(block)
    assert (first, sizes.tolist(), back.tolist()) == (7, [len(ids)], ids.tolist())
    lanes = max(1, min(token_codec.LANES, len(ids) // 64))
    for mark in range(1, -(-(-(-len(ids) // lanes)) // token_codec.CHECKPOINT_STEPS)):
        assert coder.decode(block, mark)[2].tolist() == ids[mark * token_codec.CHECKPOINT_STEPS * lanes :].tolist()


def test_damage_is_found():
    ids = np.arange(500, dtype=np.uint32) % 9
    coder = token_codec.Coder(token_codec.scaled(np.bincount(ids)))
    block = bytearray(coder.encode(ids, np.array([500]), 0))
    block[-3] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(block))


@pytest.mark.parametrize("counts", [[], [0, 0], [1], [5, 0, 1], [10**12, *[1] * 3000]])
def test_frequencies_sum_to_the_scale(counts):
    out = token_codec.scaled(np.array(counts), 12)
    there = np.array(counts) > 0
    assert out.sum() == (4096 if there.any() else 0) and (out[there] > 0).all() and not out[~there].any()


def test_token_files_equal_plain_encoding(spark, tokenizer):
    path = token_codec.new_path(spark)
    token_codec.write(edges.documents(spark), path)
    rows = token_codec.read(spark, path).collect()
    got = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in got) == Counter(
        (i, tuple(encoded(tokenizer, t))) for i, t in edges.texts()
    )


def test_token_query_and_empty_table(spark, tokenizer):
    rows = {r["doc_id"]: r for r in plans.queries()["op2_token_files"](spark, SF).collect()}
    start = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = encoded(tokenizer, r["text"])
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    path = token_codec.new_path(spark)
    token_codec.write(edges.empty(spark), path)
    assert token_codec.read(spark, path).count() == 0
