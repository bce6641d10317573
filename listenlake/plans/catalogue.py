"""Catalogue, dimension-change and row-quality queries."""

from datetime import date

from pyspark.sql import functions as F

from listenlake.functions import rules, scalars
from listenlake.operators import catalog, paging, quality
from listenlake.plans.registry import query
from listenlake.sources.domain import ctes

CATALOG_CTES = ctes("tracks", "artists", "track_artists", "track_genre_names")


def _sides(d):
    return d.track_artists(), d.artists(), d.track_genres(), d.genres()


def documents(d):
    return catalog.search_documents(d.tracks(), *_sides(d))


@query(
    "catalog_documents",
    CATALOG_CTES + """
    SELECT t.track_id, t.title, t.duration_ms, t.explicit, strftime(t.release_date, '%Y-%m-%d') AS release_date,
           coalesce(array_to_string(a.names, '|'), '') AS artists, array_to_string(g.names, '|') AS genres
    FROM tracks t
    LEFT JOIN (SELECT track_id, list_sort(list(DISTINCT name)) AS names
               FROM track_artists JOIN artists USING (artist_id) GROUP BY track_id) a USING (track_id)
    LEFT JOIN (SELECT track_id, list_sort(list(DISTINCT name)) AS names
               FROM track_genre_names GROUP BY track_id) g USING (track_id)""",
)
def catalog_documents(d):
    return documents(d).withColumns({"artists": F.concat_ws("|", "artists"), "genres": F.concat_ws("|", "genres")})


@query(
    "track_nested",
    CATALOG_CTES + """
    SELECT t.track_id, t.title, t.duration_ms, t.explicit, t.release_date,
           coalesce(a.ids, '') AS artists, coalesce(g.ids, '') AS genres
    FROM tracks t
    LEFT JOIN (SELECT track_id, string_agg(artist_id || ':' || name || ':' || CASE WHEN verified THEN 'true' ELSE 'false' END, '|' ORDER BY artist_id) AS ids
               FROM track_artists JOIN artists USING (artist_id) GROUP BY track_id) a USING (track_id)
    LEFT JOIN (SELECT track_id, string_agg(genre_id || ':' || name, '|' ORDER BY genre_id) AS ids
               FROM track_genre_names GROUP BY track_id) g USING (track_id)""",
)
def track_nested(d):
    nested = catalog.nested_tracks(d.tracks(), *_sides(d))
    return nested.withColumns(
        {
            "artists": F.concat_ws(
                "|", F.transform("artists", lambda a: F.concat_ws(":", a["artist_id"], a["name"], a["is_verified"]))
            ),
            "genres": F.concat_ws("|", F.transform("genres", lambda g: F.concat_ws(":", g["genre_id"], g["name"]))),
        }
    )


@query(
    "tracks_by_artist_page",
    ctes("tracks", "track_artists") + """
    SELECT * FROM tracks WHERE track_id IN (SELECT track_id FROM track_artists WHERE artist_id = 7)
    ORDER BY track_id LIMIT 20 OFFSET 20""",
)
def tracks_by_artist_page(d):
    found = catalog.tracks_of(d.tracks(), d.track_artists(), F.col("artist_id") == 7)
    return paging.page(found, ["track_id"], 2, 20)


@query(
    "tracks_by_genre_page",
    ctes("tracks", "track_genre_names") + """
    SELECT * FROM tracks WHERE track_id IN (SELECT track_id FROM track_genre_names WHERE name = 'PROMO')
    ORDER BY track_id LIMIT 20 OFFSET 40""",
)
def tracks_by_genre_page(d):
    found = catalog.tracks_in_genre(d.tracks(), d.track_genres(), d.genres(), "PROMO")
    return paging.page(found, ["track_id"], 3, 20)


@query(
    "first_tracks_of_every_artist",
    ctes("tracks", "track_artists") + """
    SELECT artist_id, track_id, title, duration_ms, explicit, release_date,
           CAST(row_number() OVER (PARTITION BY artist_id ORDER BY track_id) AS INTEGER) AS rank
    FROM track_artists JOIN tracks USING (track_id) QUALIFY rank <= 20""",
)
def first_tracks_of_every_artist(d):
    return catalog.first_tracks_of_each(d.tracks(), d.track_artists(), "artist_id", 20)


@query(
    "first_tracks_of_every_genre",
    ctes("tracks", "track_genre_names") + """
    SELECT genre_id, track_id, title, duration_ms, explicit, release_date,
           CAST(row_number() OVER (PARTITION BY genre_id ORDER BY track_id) AS INTEGER) AS rank
    FROM (SELECT DISTINCT track_id, genre_id FROM track_genre_names) JOIN tracks USING (track_id) QUALIFY rank <= 20""",
)
def first_tracks_of_every_genre(d):
    return catalog.first_tracks_of_each(d.tracks(), d.track_genres(), "genre_id", 20)


@query(
    "match_total",
    ctes("tracks") + """
    SELECT track_id, title, (SELECT count(*) FROM tracks WHERE explicit) AS total
    FROM tracks WHERE explicit ORDER BY track_id LIMIT 50""",
)
def match_total(d):
    found = d.tracks(release=False).where(rules.term("explicit", True)).select("track_id", "title")
    return paging.with_total(paging.page(found, ["track_id"]), found)


@query(
    "track_bitrates",
    ctes("tracks", "track_bitrates", "objects") + """
    , stored AS (SELECT DISTINCT CAST(regexp_extract(path, '([0-9]+)/[^/]+\\.mp3$', 1) AS BIGINT) AS track_id,
                 CAST(regexp_extract(path, '/([0-9]+)\\.mp3$', 1) AS INTEGER) AS bitrate FROM objects)
    SELECT track_id, title, coalesce(declared, '') AS declared, coalesce(stored, '') AS stored,
           coalesce(declared, '') = coalesce(stored, '') AS agrees
    FROM tracks
    LEFT JOIN (SELECT track_id, string_agg(bitrate, ',' ORDER BY bitrate DESC) AS declared FROM track_bitrates GROUP BY 1) USING (track_id)
    LEFT JOIN (SELECT track_id, string_agg(bitrate, ',' ORDER BY bitrate DESC) AS stored FROM stored GROUP BY 1) USING (track_id)""",
)
def track_bitrates(d):
    rows = catalog.tracks_with_bitrates(d.tracks(release=False), d.track_bitrates(), d.objects())
    return rows.withColumns({"declared": F.concat_ws(",", "declared"), "stored": F.concat_ws(",", "stored")})


@query(
    "bitrate_mismatches",
    ctes("track_bitrates", "objects") + """
    , stored AS (SELECT DISTINCT CAST(regexp_extract(path, '([0-9]+)/[^/]+\\.mp3$', 1) AS BIGINT) AS track_id,
                 CAST(regexp_extract(path, '/([0-9]+)\\.mp3$', 1) AS INTEGER) AS bitrate FROM objects)
    SELECT track_id, bitrate, 'missing' AS problem FROM (SELECT * FROM track_bitrates EXCEPT SELECT * FROM stored)
    UNION ALL
    SELECT track_id, bitrate, 'undeclared' FROM (SELECT * FROM stored EXCEPT SELECT * FROM track_bitrates)""",
)
def bitrate_mismatches(d):
    return catalog.bitrate_mismatches(d.track_bitrates(), d.objects())


@query(
    "available_bitrates",
    ctes("objects") + """
    SELECT track_id, string_agg(bitrate, ',' ORDER BY bitrate DESC) AS bitrates FROM (
        SELECT DISTINCT CAST(regexp_extract(path, '([0-9]+)/[^/]+\\.mp3$', 1) AS BIGINT) AS track_id,
               CAST(regexp_extract(path, '/([0-9]+)\\.mp3$', 1) AS INTEGER) AS bitrate FROM objects)
    GROUP BY 1""",
)
def available_bitrates(d):
    return catalog.available_bitrates(d.objects()).withColumn("bitrates", F.concat_ws(",", "bitrates"))


# -- bridge and dimension changes ----------------------------------------------------------

BRIDGE_CTES = ctes("track_genre_names") + """
    , existing AS (SELECT DISTINCT track_id, genre_id FROM track_genre_names)
    , wanted AS (SELECT DISTINCT track_id + 1 AS track_id, genre_id FROM track_genre_names)"""


def _wanted(d):
    return d.track_genres().select((F.col("track_id") + 1).alias("track_id"), "genre_id")


@query(
    "bridge_reconcile",
    BRIDGE_CTES + """
    SELECT track_id, genre_id, 'add' AS action FROM (SELECT * FROM wanted EXCEPT SELECT * FROM existing)
    UNION ALL
    SELECT track_id, genre_id, 'delete' FROM (SELECT * FROM existing EXCEPT SELECT * FROM wanted)""",
)
def bridge_reconcile(d):
    return catalog.reconcile(d.track_genres(), _wanted(d), ["track_id", "genre_id"])


@query("bridge_reconciled", BRIDGE_CTES + " SELECT track_id, genre_id FROM wanted")
def bridge_reconciled(d):
    keys = ["track_id", "genre_id"]
    actions = catalog.reconcile(d.track_genres(), _wanted(d), keys)
    return catalog.apply_reconciled(d.track_genres(), actions, keys)


@query("bridge_diff", BRIDGE_CTES + " SELECT * FROM existing EXCEPT SELECT * FROM wanted")
def bridge_diff(d):
    return d.track_genres().distinct().exceptAll(_wanted(d).distinct())


CHANGE_CTES = ctes("users") + """
    , changes AS (
        SELECT o_custkey + 500 AS user_id, CASE WHEN count(*) > 12 THEN 'delete' ELSE 'upsert' END AS op,
               CASE WHEN count(*) % 2 = 0 THEN 'new' || (o_custkey + 500) || '@example.com' END AS email,
               CASE WHEN o_custkey + 500 >= (SELECT count(*) FROM customer) THEN 'renamed' || (o_custkey + 500) END AS username
        FROM orders GROUP BY o_custkey)"""


def _user_changes(d):
    key = F.col("o_custkey") + 500
    known = d.table("customer").agg(F.count(F.lit(1))).scalar()
    return d.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select(
        key.alias("user_id"),
        F.when(F.col("n") > 12, "delete").otherwise("upsert").alias("op"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("new"), key, F.lit("@example.com"))).alias("email"),
        F.when(key >= known, F.concat(F.lit("renamed"), key)).alias("username"),
    )


@query(
    "dimension_changes",
    CHANGE_CTES + """
    SELECT user_id, coalesce(c.username, u.username) AS username, coalesce(c.email, u.email) AS email, role, nation_id
    FROM users u FULL JOIN changes c USING (user_id) WHERE op IS DISTINCT FROM 'delete'""",
)
def dimension_changes(d):
    return catalog.apply_changes(d.users(), _user_changes(d), "user_id")


@query(
    "dimension_change_counts",
    CHANGE_CTES + """
    SELECT CASE WHEN op = 'delete' AND u.user_id IS NOT NULL THEN 'deleted' WHEN op = 'delete' THEN 'ignored'
                WHEN u.user_id IS NOT NULL THEN 'updated' ELSE 'inserted' END AS change, count(*) AS affected
    FROM changes c LEFT JOIN users u ON u.user_id = c.user_id GROUP BY 1""",
)
def dimension_change_counts(d):
    return catalog.change_counts(d.users(), _user_changes(d), "user_id")


@query(
    "surrogate_keys",
    """SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY ts, event_id) AS playlist_id,
              event_id, user_id FROM events""",
)
def surrogate_keys(d):
    created = d.table("events").select("event_id", "user_id", "ts")
    return catalog.assign_ids(created, d.playlists(), "playlist_id", ["ts", "event_id"]).drop("ts")


# -- row quality -----------------------------------------------------------------------------


@query(
    "rule_violations",
    ctes("users") + """
    SELECT user_id, unnest(list_filter([
        CASE WHEN NOT regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$') THEN 'email' END,
        CASE WHEN NOT length(username) BETWEEN 3 AND 15 THEN 'username_length' END,
        CASE WHEN NOT regexp_matches(username, '^[\\p{L}\\p{N}]+$') THEN 'username_alnum' END], lambda x: x IS NOT NULL)) AS rule
    FROM users""",
)
def rule_violations(d):
    return quality.violations(
        d.users(),
        "user_id",
        {
            "email": rules.valid_email(F.col("email")),
            "username_length": rules.valid_username_length(F.col("username")),
            "username_alnum": rules.alphanumeric(F.col("username")),
        },
    )


@query(
    "track_rule_violations",
    ctes("tracks") + """
    SELECT track_id, unnest(list_filter([
        CASE WHEN NOT length(title) BETWEEN 1 AND 255 THEN 'title' END,
        CASE WHEN NOT duration_ms > 0 THEN 'duration' END,
        CASE WHEN NOT coalesce(year(release_date) BETWEEN 1900 AND 1995, FALSE) THEN 'release' END],
        lambda x: x IS NOT NULL)) AS rule
    FROM tracks""",
)
def track_rule_violations(d):
    return quality.violations(
        d.tracks(),
        "track_id",
        {
            "title": rules.valid_track_title(F.col("title")),
            "duration": rules.positive(F.col("duration_ms")),
            "release": F.year("release_date").between(1900, 1995),
        },
    )


@query(
    "event_rule_violations",
    ctes("session_events") + """
    SELECT event_id, unnest(list_filter([
        CASE WHEN bitrate IS NOT NULL AND bitrate NOT IN (128, 192, 320) THEN 'bitrate' END,
        CASE WHEN new_chunk_offset IS NOT NULL AND NOT (new_chunk_offset >= 0 AND new_chunk_offset <= 100) THEN 'offset' END],
        lambda x: x IS NOT NULL)) AS rule
    FROM session_events""",
)
def event_rule_violations(d):
    return quality.violations(
        d.session_events(),
        "event_id",
        {
            "bitrate": F.col("bitrate").isNull() | rules.valid_bitrate(F.col("bitrate")),
            "offset": F.col("new_chunk_offset").isNull()
            | rules.offset_inside(F.col("new_chunk_offset"), F.lit(100)),
        },
    )


@query("dup_users", ctes("users") + "SELECT email, count(*) AS n FROM users GROUP BY email HAVING count(*) > 1")
def dup_users(d):
    return quality.duplicates(d.users(), ["email"])


@query(
    "dup_playlist_tracks",
    ctes("playlist_tracks")
    + "SELECT playlist_id, track_id, count(*) AS n FROM playlist_tracks GROUP BY 1, 2 HAVING count(*) > 1",
)
def dup_playlist_tracks(d):
    return quality.duplicates(d.playlist_tracks(), ["playlist_id", "track_id"])


@query(
    "taken_emails",
    CHANGE_CTES + """
    SELECT DISTINCT user_id, email FROM (
        SELECT user_id + 1 AS user_id, email FROM users) c WHERE email IN (SELECT email FROM users WHERE role = 'MACHINERY')""",
)
def taken_emails(d):
    candidates = d.users().select((F.col("user_id") + 1).alias("user_id"), "email")
    return quality.taken(candidates, d.users().where("role = 'MACHINERY'"), "email").select("user_id", "email")


@query(
    "orphan_adds",
    ctes("playlist_tracks") + """
    SELECT playlist_id, track_id, position, added_at FROM (SELECT * REPLACE (track_id + 1000 AS track_id) FROM playlist_tracks) p
    WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = p.track_id)""",
)
def orphan_adds(d):
    adds = d.playlist_tracks().withColumn("track_id", F.col("track_id") + 1000)
    return quality.without_reference(adds, d.tracks(release=False), "track_id")


@query(
    "referenced_adds",
    ctes("playlist_tracks") + """
    SELECT playlist_id, track_id, position, added_at FROM (SELECT * REPLACE (track_id + 1000 AS track_id) FROM playlist_tracks) p
    WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = p.track_id)""",
)
def referenced_adds(d):
    adds = d.playlist_tracks().withColumn("track_id", F.col("track_id") + 1000)
    return quality.with_reference(adds, d.tracks(release=False), "track_id")


# -- predicates ------------------------------------------------------------------------------


@query("point_lookup", ctes("users") + "SELECT * FROM users WHERE user_id = 42 OR email = 'user7.1500@example.com' OR username = 'machinery1'")
def point_lookup(d):
    # One scan; a value that is missing matches nothing, whatever the others are.
    return d.users().where(
        (F.col("user_id") == 42) | (F.col("email") == "user7.1500@example.com") | (F.col("username") == "machinery1")
    )


@query(
    "numeric_date_range",
    ctes("tracks") + """
    SELECT * FROM tracks WHERE duration_ms BETWEEN 100000 AND 300000 AND release_date >= DATE '1995-02-01'""",
)
def numeric_date_range(d):
    return d.tracks().where(
        rules.closed_range("duration_ms", 100000, 300000) & rules.closed_range("release_date", low=date(1995, 2, 1))
    )


@query("term_filter", ctes("tracks") + "SELECT * FROM tracks WHERE explicit = FALSE")
def term_filter(d):
    return d.tracks().where(rules.term("explicit", False) & rules.term("title", None))


@query(
    "genre_any",
    CATALOG_CTES + """
    SELECT t.track_id, t.title FROM tracks t
    WHERE EXISTS (SELECT 1 FROM track_genre_names g WHERE g.track_id = t.track_id AND g.name IN ('PROMO', 'Brand#7'))""",
)
def genre_any(d):
    return documents(d).where(rules.any_of(F.col("genres"), ["PROMO", "Brand#7"])).select("track_id", "title")


@query(
    "iso_dates",
    ctes("tracks") + """
    SELECT track_id, strftime(release_date, '%Y-%m-%d') AS iso, release_date AS parsed,
           TRY_CAST(title AS DATE) AS not_a_date FROM tracks""",
)
def iso_dates(d):
    iso = scalars.iso_day(F.col("release_date"))
    return d.tracks().select(
        "track_id",
        iso.alias("iso"),
        scalars.parse_iso_day(iso).alias("parsed"),
        scalars.parse_iso_day(F.col("title")).alias("not_a_date"),
    )


@query(
    "nested_edit",
    CATALOG_CTES + """
    SELECT track_id, coalesce(string_agg(genre_id, ',' ORDER BY genre_id), '') AS dropped,
           max(added) AS added FROM (
        SELECT t.track_id, CASE WHEN g.genre_id <> 82 THEN g.genre_id END AS genre_id,
               (SELECT string_agg(x, ',' ORDER BY x) FROM (
                    SELECT genre_id AS x FROM track_genre_names n WHERE n.track_id = t.track_id
                    UNION SELECT 77)) AS added
        FROM tracks t JOIN track_genre_names g USING (track_id))
    GROUP BY track_id""",
)
def nested_edit(d):
    nested = catalog.nested_tracks(d.tracks(release=False), *_sides(d))
    ids = F.transform("genres", lambda g: g["genre_id"])
    return nested.select(
        "track_id",
        F.concat_ws(",", F.transform(scalars.list_drop(F.col("genres"), "genre_id", 82), lambda g: g["genre_id"])).alias("dropped"),
        F.concat_ws(",", F.array_sort(scalars.list_add(ids, F.lit(77)))).alias("added"),
    )


@query(
    "array_clean",
    """SELECT p_partkey AS track_id, array_to_string(list_filter(
           [CASE WHEN p_size > 25 THEN p_type END, p_brand, CASE WHEN p_size < 10 THEN p_name END],
           lambda x: x IS NOT NULL), '|') AS names FROM part""",
)
def array_clean(d):
    names = F.array(
        F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_brand"), F.when(F.col("p_size") < 10, F.col("p_name"))
    )
    return d.table("part").select(
        F.col("p_partkey").alias("track_id"), F.concat_ws("|", scalars.without_nulls(names)).alias("names")
    )
