"""Fuzzy matching against brute force, and search semantics on small catalogues."""

import random

import pytest
from pyspark.sql import functions as F

from listenlake.operators import search


def osa(a, b):
    """Optimal string alignment distance, by the textbook table."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edited(rng, word, edits):
    word = list(word)
    for _ in range(edits):
        kind, at = rng.choice("idst"), rng.randrange(max(len(word), 1))
        if kind == "i":
            word.insert(at, rng.choice("abcdefgh"))
        elif word and kind == "d":
            word.pop(at)
        elif word and kind == "s":
            word[at] = rng.choice("abcdefgh")
        elif at + 1 < len(word):
            word[at], word[at + 1] = word[at + 1], word[at]
    return "".join(word)


def budget(token):
    return 2 if len(token) >= 6 else 1 if len(token) >= 3 else 0


def test_expansion_equals_brute_force(spark):
    rng = random.Random(11)
    words, queries = set(), set()
    for length in [1, 2, 3, 5, 6, 7, 12, 23, 24, 25, 26, 27, 31, 60]:
        for _ in range(4):
            word = "".join(rng.choice("abcdefgh") for _ in range(length))
            words.add(word)
            for edits in (0, 1, 2, 3):
                queries.add(edited(rng, word, edits))
    queries.discard("")
    words_df = spark.createDataFrame([("f", w) for w in words], "field string, token string")
    query_df = spark.createDataFrame([("f", q) for q in queries], "field string, query_token string")
    found = {
        (r["query_token"], r["token"], r["distance"])
        for r in search.expand(query_df, search.word_keys(words_df)).collect()
    }
    expected = {(q, w, osa(q, w)) for q in queries for w in words if osa(q, w) <= budget(q)}
    assert found == expected
    assert any(len(q) > 24 and d == 2 for q, _, d in expected)


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, "Test Track", 300000, ["Test Artist"], ["Rock"], False, "2020-01-01"),
        (2, "Red Ring", 200000, ["Other Band"], ["Pop", "Rock"], True, "2021-05-01"),
        (3, "Red Red Wine", 180000, ["Test Band"], ["Pop"], None, None),
        (4, "Nothing", 1000, [], [], False, "2019-12-31"),
    ]
    documents = spark.createDataFrame(
        rows,
        "track_id long, title string, duration_ms int, artists array<string>, genres array<string>, "
        "explicit boolean, release_date string",
    )
    return search.SearchIndex.build(documents)


def _ids(index, **clauses):
    return [r["track_id"] for r in search.search(index, search.SearchRequest(**clauses)).collect()]


def test_text_clauses(index):
    assert _ids(index, title="red") == [3, 2]
    assert _ids(index, title="rde") == [3, 2]
    assert _ids(index, title="wine track")[0] in (1, 3)
    assert sorted(_ids(index, title="wine track")) == [1, 3]
    assert _ids(index, title="red", artist_name="tset") == [3]
    assert _ids(index, title="zebra") == []


def test_filter_clauses(index):
    assert _ids(index, genres=["Rock"]) == [1, 2]
    assert _ids(index, genres=["Rock", "Pop"], explicit=True) == [2]
    assert _ids(index, explicit=False) == [1, 4]
    assert _ids(index, min_duration_ms=180000, max_duration_ms=200000) == [2, 3]
    assert _ids(index, max_duration_ms=1000) == [4]
    import datetime as dt

    assert _ids(index, released_from=dt.date(2020, 1, 1)) == [1, 2]
    assert _ids(index, released_to=dt.date(2019, 12, 31)) == [4]
    assert _ids(index, released_from=dt.date(2030, 1, 1)) == []


def test_pages_and_total(index):
    request = search.SearchRequest(genres=["Rock", "Pop"], page=2, page_size=2)
    rows = search.search(index, request).collect()
    assert [(r["rank"], r["track_id"], r["total"]) for r in rows] == [(3, 3, 3)]


def test_requests_of_several_depths(spark, index):
    requests = search.SearchRequest(title="red", page_size=1).frame(spark)
    requests = requests.unionByName(requests.withColumn("request_id", F.lit(1).cast("long")).withColumn("page", F.lit(2)))
    rows = search.answer(requests, index).collect()
    assert {(r["request_id"], r["rank"], r["track_id"]) for r in rows} == {(0, 1, 3), (1, 2, 2)}


def test_tokens_are_expanded_once_for_all_uses(spark, index):
    bodies = search.SearchRequest(title="rde", artist_name="band").frame(spark).withColumn("body", F.lit("b"))
    read = search.matches(bodies, index).inputFiles()
    assert any("search-postings" in f for f in read) and not any("search-keys" in f for f in read)


def test_guards():
    with pytest.raises(ValueError):
        search.SearchRequest()
    with pytest.raises(ValueError):
        search.SearchRequest(title="x", page=0)
    with pytest.raises(ValueError):
        search.SearchRequest(title="x", page_size=101)
    assert search.SearchRequest(explicit=False)


@pytest.mark.parametrize("most_rows", [1 << 20, 50])
def test_tasks_hand_on_counts_and_best_rows_only(spark, most_rows):
    """One body holds most matches, scores tie, and tasks give out early where they may hold little."""
    rows = [("hot" if i % 10 else f"b{i % 7}", i, float(i * 7 % 5)) for i in range(1000)]
    found = spark.createDataFrame(rows, "body string, track_id bigint, score double").repartition(4)
    got = search.best_of_tasks(found, 3, most_rows).toPandas()
    for body in {r[0] for r in rows}:
        own = sorted((-s, t) for b, t, s in rows if b == body)
        kept = got[got.body == body]
        assert kept.matched.sum() == len(own)
        assert sorted(zip(-kept.score, kept.track_id))[:3] == own[:3]
    if most_rows > 50:
        assert len(got) <= 4 * 8 * 3
