"""Search queries."""

from datetime import date

from pyspark.sql import functions as F

from listenlake.operators import search
from listenlake.plans.catalogue import documents
from listenlake.plans.registry import query
from listenlake.sources.domain import ctes

INDEX = """
    , docs AS (
        SELECT t.*, a.names AS artists, g.names AS genres FROM tracks t
        LEFT JOIN (SELECT track_id, list_sort(list(DISTINCT name)) AS names
                   FROM track_artists JOIN artists USING (artist_id) GROUP BY track_id) a USING (track_id)
        LEFT JOIN (SELECT track_id, list_sort(list(DISTINCT name)) AS names
                   FROM track_genre_names GROUP BY track_id) g USING (track_id))
    , words AS (
        SELECT 'title' AS field, track_id, regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+') AS ws FROM docs
        UNION ALL
        SELECT 'artist_name', track_id, regexp_extract_all(lower(array_to_string(artists, ' ')), '[\\p{L}\\p{N}]+') FROM docs)
    , postings AS (SELECT field, token, track_id, length, count(*) AS tf FROM (
        SELECT field, track_id, len(ws) AS length, unnest(ws) AS token FROM words) GROUP BY ALL)
    , vocabulary AS (SELECT field, token, count(*) AS df FROM postings GROUP BY 1, 2)
    , stats AS (SELECT field, count(*) AS docs, avg(length) AS mean_length FROM
        (SELECT field, track_id, max(length) AS length FROM postings GROUP BY 1, 2) GROUP BY 1)"""
BASE = ("tracks", "artists", "track_artists", "track_genre_names")
BUDGET = "CASE WHEN length(query_token) >= 6 THEN 2 WHEN length(query_token) >= 3 THEN 1 ELSE 0 END"
SCORED = f"""
    , asked AS (SELECT body, field, query_token, count(*) AS times FROM (
        SELECT body, 'title' AS field, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) AS query_token FROM bodies
        UNION ALL
        SELECT body, 'artist_name', unnest(regexp_extract_all(lower(artist_name), '[\\p{{L}}\\p{{N}}]+')) FROM bodies)
        GROUP BY ALL)
    , expanded AS (SELECT q.field, query_token, token, df, damerau_levenshtein(query_token, token) AS distance
        FROM (SELECT DISTINCT field, query_token FROM asked) q JOIN vocabulary v ON v.field = q.field
         AND damerau_levenshtein(query_token, token) <= {BUDGET})
    , hits AS (SELECT a.body, a.field, p.track_id, a.times
          * (1 - distance / least(length(a.query_token), length(e.token))::DOUBLE)
          * ln(1 + (s.docs - e.df + 0.5) / (e.df + 0.5))
          * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.length / s.mean_length)) AS score
        FROM asked a JOIN expanded e USING (field, query_token) JOIN postings p ON p.field = e.field AND p.token = e.token
        JOIN stats s ON s.field = e.field)
    , text_scores AS (SELECT body, track_id, sum(score) AS score, count(DISTINCT field) AS fields FROM hits GROUP BY 1, 2)
    , matches AS (SELECT r.body, d.track_id, round(coalesce(t.score, 0), 6) AS score
        FROM bodies r JOIN docs d ON (r.min_duration_ms IS NULL OR d.duration_ms >= r.min_duration_ms)
         AND (r.max_duration_ms IS NULL OR d.duration_ms <= r.max_duration_ms)
         AND (r.explicit IS NULL OR d.explicit = r.explicit)
         AND (r.released_from IS NULL OR d.release_date >= r.released_from)
         AND (r.genres IS NULL OR list_has_any(d.genres, r.genres))
        LEFT JOIN text_scores t ON t.body = r.body AND t.track_id = d.track_id
        WHERE coalesce(t.fields, 0) = (r.title IS NOT NULL)::INT + (r.artist_name IS NOT NULL)::INT)"""


def _index(d):
    return search.SearchIndex.build(documents(d))


@query(
    "search_docs",
    ctes(*BASE) + INDEX + """
    SELECT d.track_id, title, explicit, strftime(release_date, '%Y-%m-%d') AS release_date, duration_ms,
           coalesce(array_to_string(artists, '|'), '') AS artists, array_to_string(genres, '|') AS genres,
           CAST(max(len(ws)) FILTER (field = 'title') AS INTEGER) AS title_words,
           CAST(coalesce(max(len(ws)) FILTER (field = 'artist_name'), 0) AS INTEGER) AS artist_words
    FROM docs d LEFT JOIN words w USING (track_id) GROUP BY ALL""",
)
def search_docs(d):
    return documents(d).withColumns(
        {
            "title_words": F.size(search.tokens(F.col("title"))),
            "artist_words": F.size(search.tokens(F.concat_ws(" ", "artists"))),
        }
    ).withColumns({"artists": F.concat_ws("|", "artists"), "genres": F.concat_ws("|", "genres")})


@query(
    "search_postings",
    ctes(*BASE) + INDEX + " SELECT field, token, track_id, CAST(length AS INTEGER) AS length, tf FROM postings",
)
def search_postings(d):
    return search.postings(documents(d))


@query("search_vocabulary", ctes(*BASE) + INDEX + " SELECT field, token, df FROM vocabulary")
def search_vocabulary(d):
    return search.vocabulary(search.postings(documents(d)))


@query(
    "search_fuzzy",
    ctes(*BASE, "search_requests") + INDEX + f"""
    , q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) AS query_token FROM search_requests)
    SELECT 'title' AS field, query_token, token, CAST(damerau_levenshtein(query_token, token) AS INTEGER) AS distance
    FROM q JOIN vocabulary v ON v.field = 'title' AND damerau_levenshtein(query_token, token) <= {BUDGET}""",
)
def search_fuzzy(d):
    asked = d.search_requests().select(
        F.lit("title").alias("field"), F.explode(search.tokens(F.col("title"))).alias("query_token")
    )
    return search.expand(asked, search.word_keys(search.vocabulary(search.postings(documents(d)))))


# Every artist token with one letter changed, against all artist tokens: long, near-equal words.
@query(
    "search_fuzzy_artists",
    ctes(*BASE) + INDEX + f"""
    , q AS (SELECT DISTINCT token || 'x' AS query_token FROM vocabulary WHERE field = 'artist_name')
    SELECT 'artist_name' AS field, query_token, token, CAST(damerau_levenshtein(query_token, token) AS INTEGER) AS distance
    FROM q JOIN vocabulary v ON v.field = 'artist_name' AND damerau_levenshtein(query_token, token) <= {BUDGET}""",
)
def search_fuzzy_artists(d):
    words = search.vocabulary(search.postings(documents(d)).where("field = 'artist_name'"))
    asked = words.select("field", F.concat("token", F.lit("x")).alias("query_token"))
    return search.expand(asked, search.word_keys(words))


ONE_REQUEST = """
    , bodies AS (SELECT 'b' AS body, {title} AS title, {artist} AS artist_name, {genres} AS genres,
                 {low} AS min_duration_ms, {high} AS max_duration_ms, {explicit} AS explicit, {released} AS released_from)"""
PAGE = """
    SELECT m.track_id, d.title, m.score, row_number() OVER (ORDER BY m.score DESC, m.track_id) AS rank, count(*) OVER () AS total
    FROM matches m JOIN docs d USING (track_id) QUALIFY rank BETWEEN {first} AND {last}"""


def _page(found):
    return found.select("track_id", "title", "score", F.col("rank").cast("long").alias("rank"), "total")


@query(
    "search_bm25",
    ctes(*BASE) + INDEX
    + ONE_REQUEST.format(title="'red ring'", artist="CAST(NULL AS VARCHAR)", genres="CAST(NULL AS VARCHAR[])", low="NULL", high="NULL", explicit="NULL", released="NULL")
    + SCORED + PAGE.format(first=1, last=50),
)
def search_bm25(d):
    return _page(search.search(_index(d), search.SearchRequest(title="red ring")))


@query(
    "search_exact",
    ctes(*BASE) + INDEX
    + ONE_REQUEST.format(title="'rign'", artist="'supplier'", genres="['PROMO', 'Brand#7']", low="100000", high="400000", explicit="FALSE", released="DATE '1995-01-02'")
    + SCORED + PAGE.format(first=1, last=20),
)
def search_exact(d):
    request = search.SearchRequest(
        title="rign", artist_name="supplier", genres=["PROMO", "Brand#7"], min_duration_ms=100000,
        max_duration_ms=400000, explicit=False, released_from=date(1995, 1, 2), page_size=20,
    )
    return _page(search.search(_index(d), request))


@query(
    "search_filters_only",
    ctes(*BASE) + INDEX
    + ONE_REQUEST.format(title="CAST(NULL AS VARCHAR)", artist="CAST(NULL AS VARCHAR)", genres="CAST(NULL AS VARCHAR[])", low="200000", high="NULL", explicit="TRUE", released="NULL")
    + SCORED + PAGE.format(first=31, last=60),
)
def search_filters_only(d):
    request = search.SearchRequest(min_duration_ms=200000, explicit=True, page=2, page_size=30)
    return _page(search.search(_index(d), request))


@query(
    "search_pages_by_cursor",
    "SELECT track_id, score FROM (" + ctes(*BASE) + INDEX
    + ONE_REQUEST.format(title="'red ring'", artist="CAST(NULL AS VARCHAR)", genres="CAST(NULL AS VARCHAR[])", low="NULL", high="NULL", explicit="NULL", released="NULL")
    + SCORED + PAGE.format(first=21, last=40) + ")",
)
def search_pages_by_cursor(d):
    """The second page of twenty, from the last row of the first."""
    index, request = _index(d), search.SearchRequest(title="red ring", page_size=20)
    last = search.next_page(index, request, None).tail(1)
    return search.next_page(index, request, last[0].asDict() if last else None)


@query(
    "search_batch",
    ctes(*BASE, "search_requests") + INDEX + """
    , stamped AS (SELECT *, md5(concat_ws('~', coalesce(title, '-'), coalesce(artist_name, '-'), coalesce(array_to_string(genres, ','), '-'),
        coalesce(min_duration_ms, -1), coalesce(max_duration_ms, -1), coalesce(explicit, FALSE), coalesce(released_from, DATE '1970-01-01'))) AS body
        FROM search_requests)
    , bodies AS (SELECT DISTINCT body, title, artist_name, genres, min_duration_ms, max_duration_ms, explicit, released_from FROM stamped)"""
    + SCORED + """
    , ranked AS (SELECT body, track_id, score, row_number() OVER (PARTITION BY body ORDER BY score DESC, track_id) AS rank,
                 count(*) OVER (PARTITION BY body) AS total FROM matches)
    SELECT request_id, CAST(rank AS INTEGER) AS rank, track_id, score, total
    FROM stamped JOIN ranked USING (body) WHERE rank > (page - 1) * page_size AND rank <= page * page_size""",
)
def search_batch(d):
    return search.answer(d.search_requests(), _index(d))
