"""The pipeline's stages against plain computations on their own inputs."""

import re

import numpy as np
import pytest

import corpus_pipeline
import edges
from listenlake.llm import decontam, quality, simhash
from test_duplicates import plain_hits
from test_text_rules import plain_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.cache()]
    for _, apply in corpus_pipeline.STAGES:
        found.append(apply(spark, found[-1], SF).cache())
    yield found
    for df in found:
        df.unpersist()


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]
    assert all(df.columns == stages[0].columns and df.dtypes == stages[0].dtypes for df in stages[1:5])


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].join(labels, "doc_id")
    all_ = stages[0].join(labels, "doc_id")
    good = lambda df, q: df.where(f"quality = {q}").count()
    assert good(kept, 1) >= 0.98 * good(all_, 1) and good(kept, 0) <= 0.12 * good(all_, 0)
    assert all(quality.counts(t.encode())[0] >= 10 for t in texts(stages[1]).values())


def test_one_of_each_group_stays(stages):
    given, kept = texts(stages[1]), texts(stages[2])
    prints = {k: simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3)) for k, t in given.items()}
    keys = sorted(given)
    own = np.array([prints[k] for k in keys], np.uint64)
    seen, expected = set(), set()
    for k in keys:  # components, each named by its smallest id
        if k not in seen:
            expected.add(k)
            open_ = [k]
            while open_:
                n = open_.pop()
                if n not in seen:
                    seen.add(n)
                    open_ += [keys[i] for i in np.flatnonzero(np.bitwise_count(own ^ np.uint64(prints[n])) <= 2)]
    assert set(kept) == expected and len(expected) < len(given)
    assert all(kept[k] == given[k] for k in kept)


def test_contaminated_documents_go(spark, stages):
    given, kept = texts(stages[2]), texts(stages[3])
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[a : a + 13]) for _, t in items for w in [decontam.words_of(t)] for a in range(max(1, len(w) - 12))}
    gone = set(given) - set(kept)
    assert gone
    for k, t in given.items():
        own = decontam.words_of(t.encode())
        if any(tuple(own[a : a + 13]) in grams for a in range(len(own))):
            hit, _ = plain_hits(t.encode(), items, 13)
            assert (k in gone) == (20 * int(hit.sum()) >= len(own))
        else:
            assert k not in gone


def test_secrets_are_replaced_and_all_documents_stay(stages):
    given, clean = texts(stages[3]), texts(stages[4])
    assert set(given) == set(clean)
    for k, t in given.items():
        assert (clean[k] == t) == (not plain_spans(t))
        assert not plain_spans(clean[k]) and len(re.findall(r"\[REDACTED\]", clean[k])) <= len(plain_spans(t))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_sequences_hold_the_kept_documents(spark, stages):
    packed = stages[5]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts(stages[4]))
    assert packed.selectExpr("max(length)").first()[0] <= 2048
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_in_edge_cases(spark):
    docs = edges.documents(spark)
    for name, apply in corpus_pipeline.STAGES:
        assert apply(spark, edges.empty(spark), SF).count() == 0
        out = apply(spark, docs, SF)
        assert out.count() <= docs.count() * (1 if name != "packing" else 10_000)
        if name != "packing":
            assert out.columns == docs.columns
