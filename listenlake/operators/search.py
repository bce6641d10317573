"""Search as batch jobs: postings, fuzzy token expansion, BM25, answers to tables of requests.

A document matches a request when every given clause matches. A text clause (title, artist)
matches when any of its tokens does, within an edit budget that depends on token length.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.functions.rules import check_any_filter, check_page
from listenlake.functions.scalars import fingerprint
from listenlake.operators import ordered, paging
from listenlake.session import fine_pieces, freeze

# Token pattern, BM25 parameters, edit budget by token length.
TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
ONE_EDIT_FROM, TWO_EDITS_FROM = 3, 6

#: Query tokens up to this length are matched through deletions, longer ones through
#: segments, whose number does not grow with the token.
DELETION_LENGTH = 24
SEGMENTS, MAX_SHIFT = 5, 2

FIELDS = ["title", "artist_name"]
REQUEST_COLUMNS = """
title string, artist_name string, genres array<string>, min_duration_ms int, max_duration_ms int,
explicit boolean, released_from date, released_to date
"""
_CLAUSES = [c.split()[0] for c in REQUEST_COLUMNS.replace("\n", " ").split(",")]


@dataclass(frozen=True)
class SearchRequest:
    """One search; every filter is optional, at least one must be given."""

    title: str | None = None
    artist_name: str | None = None
    genres: list[str] | None = None
    min_duration_ms: int | None = None
    max_duration_ms: int | None = None
    explicit: bool | None = None
    released_from: date | None = None
    released_to: date | None = None
    page: int = 1
    page_size: int = 50

    def __post_init__(self):
        check_page(self.page, self.page_size)
        check_any_filter(**{c: getattr(self, c) for c in _CLAUSES})

    def frame(self, spark: SparkSession) -> DataFrame:
        row = {"request_id": 0, **asdict(self)}
        return spark.createDataFrame([row], f"request_id bigint, {REQUEST_COLUMNS}, page int, page_size int")


# -- index -----------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(documents: DataFrame) -> DataFrame:
    """(field, token, track_id, tf, length): how often each token occurs in each field."""
    texts = F.array(
        F.struct(F.lit("title").alias("field"), tokens(F.col("title")).alias("words")),
        F.struct(F.lit("artist_name").alias("field"), tokens(F.concat_ws(" ", "artists")).alias("words")),
    )
    # Dealt before the words are unfolded: a document's words are grouped where it is.
    dealt = fine_pieces(documents.select("track_id", "title", "artists"), "track_id")
    words = dealt.select("track_id", F.inline(texts)).select(
        "track_id", "field", F.size("words").alias("length"), F.explode("words").alias("token")
    )
    return words.groupBy("field", "token", "track_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """(field, token, df): in how many documents each token occurs."""
    return postings.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))


def field_statistics(postings: DataFrame) -> DataFrame:
    """(field, docs, mean_length), from the documents that have the field."""
    per_document = postings.groupBy("field", "track_id").agg(F.max("length").alias("length"))
    return per_document.groupBy("field").agg(
        F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length")
    )


@dataclass(frozen=True)
class SearchIndex:
    """Tables written once and read by every batch of requests."""

    documents: DataFrame
    postings: DataFrame
    words: DataFrame
    keys: DataFrame

    @classmethod
    def build(cls, documents: DataFrame) -> SearchIndex:
        stored = freeze(documents, "search-documents")
        # Sorted by token, so a batch's tokens prune row groups; ranges split a token found
        # in very many documents.
        pieces = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = postings(stored).repartitionByRange(pieces, "field", "token", "track_id")
        index = freeze(placed.sortWithinPartitions("field", "token"), "search-postings")
        words = freeze(vocabulary(index).join(field_statistics(index), "field"), "search-words")
        return cls(stored, index, words, freeze(word_keys(words), "search-keys"))


# -- fuzzy expansion -------------------------------------------------------------------


def edit_budget(token: Column) -> Column:
    length = F.char_length(token)
    return F.when(length >= TWO_EDITS_FROM, 2).when(length >= ONE_EDIT_FROM, 1).otherwise(0)


def _one_swap(a: str, b: str) -> str:
    """``b`` is ``a`` with one pair of neighbours exchanged."""
    return f"""CASE WHEN length({a}) = length({b}) AND length({a}) >= 2 THEN exists(
        sequence(1, length({a}) - 1),
        s -> concat(substr({a}, 1, s - 1), substr({a}, s + 1, 1), substr({a}, s, 1), substr({a}, s + 2)) = {b}
    ) ELSE false END"""


def _one_edit(a: str, b: str) -> str:
    return f"(levenshtein({a}, {b}, 1) >= 0 OR {_one_swap(a, b)})"


def _two_edits(a: str, b: str) -> str:
    """At most two edits, a swap of neighbours counting as one.

    Besides plain edits: a swap at place i, and one edit in what lies before or after it.
    """
    pair = f"concat(substr({a}, i + 1, 1), substr({a}, i, 1))"
    head, tail = f"substr({a}, 1, i - 1)", f"substr({a}, i + 2)"
    before = f"(length({b}) - length({tail}) - 2)"
    edit_after = f"(startswith({b}, concat({head}, {pair})) AND {_one_edit(tail, f'substr({b}, i + 2)')})"
    edit_before = (
        f"({before} >= 0 AND endswith({b}, concat({pair}, {tail})) "
        f"AND {_one_edit(head, f'substr({b}, 1, greatest({before}, 0))')})"
    )
    return f"""(levenshtein({a}, {b}, 2) >= 0 OR CASE WHEN length({a}) >= 2 THEN
        exists(sequence(1, length({a}) - 1), i -> {edit_after} OR {edit_before}) ELSE false END)"""


def distance_within(a: str, b: str, budget: str) -> Column:
    """Edits between two token columns when within the budget (0 to 2), else null."""
    return F.expr(
        f"CASE WHEN {a} = {b} THEN 0 WHEN {budget} >= 1 AND {_one_edit(a, b)} THEN 1 "
        f"WHEN {budget} >= 2 AND {_two_edits(a, b)} THEN 2 END"
    )


def _without_one(words: Column) -> Column:
    """Every word with each one of its characters left out."""

    def shorter(word: Column) -> Column:
        places = F.sequence(F.lit(1), F.char_length(word))
        drop = F.transform(
            places, lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.char_length(word)))
        )
        return F.when(F.char_length(word) > 0, drop).otherwise(F.array(F.lit("")))

    return F.array_distinct(F.flatten(F.transform(words, shorter)))


def _deletions(token: Column, edits: Column) -> Column:
    """The token and what is left after up to ``edits`` deletions."""
    none = F.array(token)
    one = _without_one(none)
    return (
        F.when(edits >= 2, F.array_union(F.array_union(none, one), _without_one(one)))
        .when(edits == 1, F.array_union(none, one))
        .otherwise(none)
    )


def _segment(token: Column, part: Column, length: Column, shift: Column) -> Column:
    """Key of one of the equal parts of a token of ``length``, read ``shift`` places off."""
    width = F.floor(length / SEGMENTS).cast("int")
    text = token.substr(F.greatest(F.lit(1), part * width + 1 + shift), width)
    return F.concat_ws("\u0001", part.cast("string"), length.cast("string"), text)


def _query_segments(token: Column) -> Column:
    parts = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))
    return F.transform(parts, lambda p: _segment(token, p, F.char_length(token), F.lit(0)))


def _stored_segments(token: Column) -> Column:
    """Keys under which a query of nearly the same length can find this token."""
    parts = F.sequence(F.lit(0), F.lit(SEGMENTS - 1))
    offs = F.sequence(F.lit(-MAX_SHIFT), F.lit(MAX_SHIFT))

    def for_length(off: Column) -> Column:
        return F.flatten(
            F.transform(parts, lambda p: F.transform(offs, lambda s: _segment(token, p, F.char_length(token) + off, s)))
        )

    return F.array_distinct(F.flatten(F.transform(offs, for_length)))


def word_keys(words: DataFrame) -> DataFrame:
    """(field, token, key): the strings a near query token can share with each word."""
    t = F.col("token")
    length = F.char_length(t)
    none = F.array().cast("array<string>")
    # A word is found by two deletions only from queries of six or more characters.
    reach = F.when(length >= TWO_EDITS_FROM - 2, 2).when(length >= ONE_EDIT_FROM - 1, 1).otherwise(0)
    by_deletion = F.when(length <= DELETION_LENGTH + 2, _deletions(t, reach)).otherwise(none)
    by_segment = F.when(length > DELETION_LENGTH - 2, _stored_segments(t)).otherwise(none)
    return words.select("field", "token", F.explode(F.concat(by_deletion, by_segment)).alias("key"))


def expand(query_tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """Vocabulary tokens within each query token's budget: (field, query_token, token, distance).

    Candidates share a key: a string both reach by deletions or, for long tokens, one of
    five parts of the query token that at most two edits must leave whole. No query token
    meets the whole vocabulary.
    """
    q = F.col("query_token")
    asked = query_tokens.select("field", "query_token").distinct().withColumn("budget", edit_budget(q))
    own = F.when(F.char_length(q) > DELETION_LENGTH, _query_segments(q)).otherwise(_deletions(q, F.col("budget")))
    candidates = (
        asked.select("field", "query_token", "budget", F.explode(own).alias("key"))
        .join(keys, ["field", "key"])
        .select("field", "query_token", "budget", "token")
        .distinct()
    )
    return (
        candidates.withColumn("distance", distance_within("query_token", "token", "budget"))
        .where(F.col("distance").isNotNull())
        .select("field", "query_token", "token", "distance")
    )


# -- ranking ---------------------------------------------------------------------------


def weighted_terms(expansions: DataFrame, words: DataFrame) -> DataFrame:
    """Expansions with their term weight: idf, lowered for words that are only near."""
    near = 1 - F.col("distance") / F.least(F.char_length("query_token"), F.char_length("token"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return expansions.join(words, ["field", "token"]).select(
        "field", "query_token", "token", "mean_length", "df", (idf * near).alias("weight")
    )


def term_score() -> Column:
    """BM25 share of one term in one document."""
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    return F.col("weight") * F.col("tf") / (F.col("tf") + norm)


def wanted_terms(asked: DataFrame, index: SearchIndex) -> DataFrame:
    """Terms that each text clause accepts, and whether the clause is its body's rarest.

    ``asked`` holds (body, field, query_token, times). The rarest clause has the fewest
    postings; bodies in which some clause accepts no term at all are left out.
    """
    terms = weighted_terms(expand(asked, index.keys), index.words)
    wanted = asked.join(terms, ["field", "query_token"])
    clauses = asked.groupBy("body").agg(F.count_distinct("field").alias("given"))
    costs = wanted.groupBy("body", "field").agg(F.sum("df").alias("cost"))
    rarest = costs.groupBy("body").agg(F.min_by("field", F.struct("cost", "field")).alias("rarest"), F.count("*").alias("met"))
    known = rarest.join(clauses, "body").where("met = given").select("body", "rarest")
    return wanted.join(known, "body").withColumn("first", F.col("field") == F.col("rarest")).drop("rarest", "df")


def rarest_scores(wanted: DataFrame, index: SearchIndex) -> DataFrame:
    """(body, track_id, score): documents that meet the body's rarest clause, with that clause's BM25.

    Postings are dealt by document before they meet the terms, so that where the terms are few
    enough to go to every task, the many matches are summed and checked where they arise.
    """
    hits = index.postings.repartition("track_id").join(wanted.where("first"), ["field", "token"])
    return hits.groupBy("body", "track_id").agg(F.sum(F.col("times") * term_score()).alias("score"))


def add_other_scores(asked: DataFrame, wanted: DataFrame, index: SearchIndex) -> DataFrame:
    """Candidates of bodies with two clauses that meet the other clause too, scores added."""
    others = wanted.where("NOT first")
    hits = (
        asked.select("body", "track_id")
        .join(others, "body")
        .join(index.postings, ["field", "token", "track_id"])
        .groupBy("body", "track_id")
        .agg(F.sum(F.col("times") * term_score()).alias("more"))
    )
    return asked.join(hits, ["body", "track_id"]).select("body", "track_id", (F.col("score") + F.col("more")).alias("score"))


# -- answering -------------------------------------------------------------------------

DURATION_STEP_MS = 60_000


def _filter_candidates(bodies: DataFrame, documents: DataFrame) -> DataFrame:
    """(body, track_id) for requests without text, found through one given clause each.

    Genres and the explicit flag are equalities; ranges are cut into steps (minutes of
    length, months of release) so that they become equalities too. The step range is closed
    with the documents' own smallest and largest step.
    """
    month = F.floor(F.months_between(F.trunc("release_date", "month"), F.lit("1970-01-01").cast("date"))).cast("int")
    minute = F.floor(F.col("duration_ms") / DURATION_STEP_MS).cast("int")
    keyed = documents.select("track_id", "genres", "explicit", minute.alias("_minute"), month.alias("_month"))
    edges = keyed.agg(
        F.min("_minute").alias("m0"), F.max("_minute").alias("m1"), F.min("_month").alias("d0"), F.max("_month").alias("d1")
    )

    def edge(name: str) -> Column:
        return edges.select(name).scalar()

    def month_of(day: str) -> Column:
        return F.floor(F.months_between(F.trunc(day, "month"), F.lit("1970-01-01").cast("date"))).cast("int")

    def steps(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    by_length = F.col("min_duration_ms").isNotNull() | F.col("max_duration_ms").isNotNull()
    by_release = F.col("released_from").isNotNull() | F.col("released_to").isNotNull()
    drive = (
        F.when(F.size("genres") > 0, "genre").when(by_length, "length").when(by_release, "release").otherwise("explicit")
    )
    chosen = bodies.withColumn("_drive", drive)

    genre = chosen.where("_drive = 'genre'").select("body", F.explode("genres").alias("_key")).join(
        keyed.select("track_id", F.explode("genres").alias("_key")), "_key"
    )
    low = F.greatest(edge("m0"), F.floor(F.col("min_duration_ms") / DURATION_STEP_MS).cast("int"))
    high = F.least(edge("m1"), F.floor(F.col("max_duration_ms") / DURATION_STEP_MS).cast("int"))
    length = chosen.where("_drive = 'length'").select("body", F.explode(steps(low, high)).alias("_key")).join(
        keyed.select("track_id", F.col("_minute").alias("_key")), "_key"
    )
    low, high = F.greatest(edge("d0"), month_of("released_from")), F.least(edge("d1"), month_of("released_to"))
    release = chosen.where("_drive = 'release'").select("body", F.explode(steps(low, high)).alias("_key")).join(
        keyed.select("track_id", F.col("_month").alias("_key")), "_key"
    )
    explicit = chosen.where("_drive = 'explicit'").select("body", F.col("explicit").alias("_key")).join(
        keyed.select("track_id", F.col("explicit").alias("_key")), "_key"
    )
    parts = [p.select("body", "track_id") for p in (genre, length, release, explicit)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return union.distinct().withColumn("score", F.lit(0.0))


def _passes() -> Column:
    """Every filter clause given in ``r`` holds for document ``d``."""

    def given(clause: str, holds: Column) -> Column:
        return F.col(f"r.{clause}").isNull() | holds

    released = F.to_date("d.release_date")
    return (
        given("min_duration_ms", F.col("d.duration_ms") >= F.col("r.min_duration_ms"))
        & given("max_duration_ms", F.col("d.duration_ms") <= F.col("r.max_duration_ms"))
        & given("explicit", F.col("d.explicit") == F.col("r.explicit"))
        & given("released_from", released >= F.col("r.released_from"))
        & given("released_to", released <= F.col("r.released_to"))
        & (
            F.coalesce(F.size("r.genres") <= 0, F.lit(True))
            | F.coalesce(F.arrays_overlap("d.genres", "r.genres"), F.lit(False))
        )
    )


def matches(bodies: DataFrame, index: SearchIndex, text: bool = True, plain: bool = True) -> DataFrame:
    """(body, track_id, score) of every document each request body matches.

    ``text`` and ``plain`` tell whether bodies with and without text clauses occur.
    """
    found = []
    if text:
        # Written, as each use would expand all tokens again, and so that their size is known.
        wanted = freeze(wanted_terms(_asked_tokens(bodies), index), "search-terms")
        two = wanted.where("NOT first").select("body").distinct()
        alone, asked = (
            _checked(rarest_scores(wanted.join(two, "body", kind), index), bodies, index) for kind in ("left_anti", "left_semi")
        )
        found += [alone, add_other_scores(asked, wanted, index)]
    if plain:
        bare = bodies.where(_text_clauses() == 0)
        found.append(_checked(_filter_candidates(bare, index.documents), bodies, index))
    all_found = reduce(DataFrame.unionByName, found)
    # Rounding makes equal scores equal whatever the order of summing.
    return all_found.withColumn("score", F.round("score", 6))


def _checked(candidates: DataFrame, bodies: DataFrame, index: SearchIndex) -> DataFrame:
    """Candidates (body, track_id, score) that pass every filter of their body."""
    return (
        candidates.alias("c")
        .join(index.documents.alias("d"), F.col("c.track_id") == F.col("d.track_id"))
        .join(bodies.alias("r"), F.col("c.body") == F.col("r.body"))
        .where(_passes())
        .select("c.body", "c.track_id", "c.score")
    )


def _text_clauses() -> Column:
    """How many text clauses a request has."""
    given = [F.coalesce(F.char_length(c) > 0, F.lit(False)).cast("int") for c in FIELDS]
    return given[0] + given[1]


def _asked_tokens(bodies: DataFrame) -> DataFrame:
    """(body, field, query_token, times) of all text clauses."""
    texts = F.array(
        *[F.struct(F.lit(c).alias("field"), F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias("words")) for c in FIELDS]
    )
    words = bodies.select("body", F.inline(texts)).select("body", "field", F.explode("words").alias("query_token"))
    return words.groupBy("body", "field", "query_token").agg(F.count(F.lit(1)).alias("times"))


def answer(requests: DataFrame, index: SearchIndex, text: bool = True, plain: bool = True) -> DataFrame:
    """Answer a table of requests: (request_id, rank, track_id, score, total).

    Equal requests are answered once. Matches are counted and cut to the deepest page asked for
    in the tasks that find them; only what is left is written and shuffled. That depth is read
    from the requests when this is called, so building the answer starts jobs.
    """
    stamped = requests.withColumn("body", fingerprint(_CLAUSES))
    bodies = freeze(stamped.select("body", *_CLAUSES).dropDuplicates(["body"]), "search-bodies")
    deepest = requests.agg(F.max(F.col("page") * F.col("page_size"))).first()[0] or 0
    found = freeze(best_of_tasks(matches(bodies, index, text, plain), int(deepest)), "search-best")
    totals = found.groupBy("body").agg(F.sum("matched").alias("total"))
    ranked = paging.top_of_each(found.drop("matched"), ["body"], ["-score", "track_id"], int(deepest))
    shown = (F.col("rank") > (F.col("page") - 1) * F.col("page_size")) & (F.col("rank") <= F.col("page") * F.col("page_size"))
    return (
        stamped.select("request_id", "body", "page", "page_size")
        .join(ranked, "body")
        .where(shown)
        .join(totals, "body")
        .select("request_id", F.col("rank").cast("int").alias("rank"), "track_id", "score", "total")
    )


def best_of_tasks(found: DataFrame, depth: int, most_rows: int = 1 << 20) -> DataFrame:
    """(body, track_id, score, matched): the best ``depth`` rows a body of every task, best first.

    ``matched`` sums up to the number of all matches of a body: it stands on one row of each
    body a task gives out and is 0 on the others. A task that holds more than ``most_rows``
    gives out what it has and begins anew, so its memory does not grow with the requests.
    """
    depth = max(depth, 1)  # a body's count needs a row to stand on

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        body = pd.factorize(rows["body"])[0]
        matched = np.bincount(body, rows["matched"]).astype("int64")
        order = np.lexsort((rows["track_id"], -rows["score"], body))
        body = body[order]
        place = np.arange(len(body)) - np.searchsorted(body, body)
        kept = place < depth
        return rows.iloc[order[kept]].assign(matched=np.where(place == 0, matched[body], 0)[kept])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0
        for batch in batches:
            held.append(batch.assign(matched=1))
            waiting += len(batch)
            if waiting > most_rows:
                best = cut(pd.concat(held))
                held, waiting = [best], len(best)
                if waiting > most_rows // 2:
                    yield best
                    held, waiting = [], 0
        if held:
            yield cut(pd.concat(held))

    fields = {f.name: f.dataType.simpleString() for f in found.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in ("body", "track_id", "score")) + ", matched bigint"
    return found.select("body", "track_id", "score").mapInPandas(task, schema)


def next_page(index: SearchIndex, request: SearchRequest, cursor: Mapping | None) -> DataFrame:
    """``track_id, score``: the page after the cursor row (its ``score`` and ``track_id``), best first.

    Matches that are not after the cursor go before anything is sorted, so a deep page costs
    what the first one does. ``request.page`` plays no part.
    """
    text = bool(request.title or request.artist_name)
    bodies = request.frame(index.documents.sparkSession).withColumn("body", fingerprint(_CLAUSES)).select("body", *_CLAUSES)
    found = matches(bodies, index, text=text, plain=not text).select("track_id", "score")
    return paging.next_page(found, ["-score", "track_id"], cursor, request.page_size)


def search(index: SearchIndex, request: SearchRequest) -> DataFrame:
    """One request's page of documents, best first, with the total number of matches."""
    asked = request.frame(index.documents.sparkSession)
    text = bool(request.title or request.artist_name)
    found = answer(asked, index, text=text, plain=not text)
    return found.drop("request_id").join(index.documents, "track_id").orderBy("rank")
