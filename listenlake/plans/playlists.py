"""Playlist, like and history queries."""

from pyspark.sql import functions as F

from listenlake.functions import rules, scalars
from listenlake.operators import history, ordered, paging, playlists
from listenlake.plans.registry import query
from listenlake.session import freeze
from listenlake.sources.domain import ctes


@query(
    "user_playlists",
    ctes("playlists", "playlist_users", "playlist_tracks") + """
    SELECT p.playlist_id, name, is_public, t.track_id, t.position FROM playlists p
    LEFT JOIN playlist_tracks t USING (playlist_id)
    WHERE p.playlist_id IN (SELECT playlist_id FROM playlist_users WHERE user_id = 42)""",
)
def user_playlists(d):
    mine = playlists.of_user(d.playlists(), d.playlist_users(), 42)
    return mine.join(d.playlist_tracks(), "playlist_id", "left").select(
        "playlist_id", "name", "is_public", "track_id", "position"
    )


@query(
    "user_playlist_members",
    ctes("playlists", "playlist_users", "playlist_tracks") + """
    SELECT p.playlist_id, name, is_public, kind, member_id, position, is_creator FROM playlists p LEFT JOIN (
        SELECT playlist_id, 'track' AS kind, track_id AS member_id, position, CAST(NULL AS BOOLEAN) AS is_creator FROM playlist_tracks
        UNION ALL SELECT playlist_id, 'user', user_id, NULL, is_creator FROM playlist_users) m USING (playlist_id)
    WHERE p.playlist_id IN (SELECT playlist_id FROM playlist_users WHERE user_id = 42)""",
)
def user_playlist_members(d):
    mine = playlists.of_user(d.playlists(), d.playlist_users(), 42)
    return playlists.with_members(mine, d.playlist_tracks(), d.playlist_users()).select(
        "playlist_id", "name", "is_public", "kind", "member_id", "position", "is_creator"
    )


@query(
    "playlists_with_track",
    ctes("playlists", "playlist_tracks") + """
    SELECT * FROM playlists WHERE playlist_id IN (SELECT playlist_id FROM playlist_tracks WHERE track_id = 99)""",
)
def playlists_with_track(d):
    return playlists.with_track(d.playlists(), d.playlist_tracks(), 99)


@query(
    "playlists_of_every_user",
    ctes("playlists", "playlist_users") + """
    SELECT user_id, playlist_id, bool_or(is_creator) AS is_creator, name, is_public, created_at
    FROM playlist_users JOIN playlists USING (playlist_id) GROUP BY ALL""",
)
def playlists_of_every_user(d):
    return playlists.of_every_user(d.playlists(), d.playlist_users())


@query(
    "playlists_of_every_track",
    ctes("playlists", "playlist_tracks") + """
    SELECT DISTINCT track_id, playlist_id, name, is_public, created_at
    FROM playlist_tracks JOIN playlists USING (playlist_id)""",
)
def playlists_of_every_track(d):
    return playlists.of_every_track(d.playlists(), d.playlist_tracks())


@query(
    "playlist_track_count",
    ctes("playlists", "playlist_tracks") + """
    SELECT p.*, coalesce(n, 0) AS track_count FROM playlists p
    LEFT JOIN (SELECT playlist_id, count(*) AS n FROM playlist_tracks GROUP BY 1) USING (playlist_id)""",
)
def playlist_track_count(d):
    return playlists.track_counts(d.playlists(), d.playlist_tracks())


@query(
    "playlist_tracks_meta",
    ctes("playlist_tracks", "tracks") + """
    SELECT playlist_id, position, track_id, title, duration_ms FROM playlist_tracks JOIN tracks USING (track_id)""",
)
def playlist_tracks_meta(d):
    return playlists.tracks_with_titles(d.playlist_tracks(), d.tracks(release=False))


@query(
    "playlist_subscribers",
    ctes("playlist_users", "users") + """
    SELECT playlist_id, user_id, username FROM playlist_users JOIN users USING (user_id) WHERE NOT is_creator""",
)
def playlist_subscribers(d):
    return playlists.subscribers(d.playlist_users(), d.users())


@query(
    "playlist_assembled",
    ctes("playlists", "playlist_tracks") + """
    SELECT p.*, o_custkey AS owner_id, track_id, position, added_at FROM playlists p
    JOIN orders ON o_orderkey = p.playlist_id LEFT JOIN playlist_tracks t ON t.playlist_id = p.playlist_id""",
)
def playlist_assembled(d):
    return playlists.assemble(d.playlists(), d.playlist_users(), d.playlist_tracks())


@query(
    "ordered_items",
    """SELECT conv_id AS playlist_id, turn AS position, role,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations""",
)
def ordered_items(d):
    items = d.table("conversations").select(
        F.col("conv_id").alias("playlist_id"), F.col("turn").alias("position"), "role"
    )
    rows = ordered.OrderedRows.of(items, ["playlist_id"], ["position"]).add(_n=ordered.row_number()).frame()
    return rows.withColumn("ordinal", F.col("_n") - 1).drop("_n")


@query(
    "visible_playlists",
    ctes("playlists") + """
    SELECT p.*, o_custkey AS owner_id FROM playlists p JOIN orders ON o_orderkey = playlist_id
    WHERE is_public OR o_custkey = 42""",
)
def visible_playlists(d):
    return playlists.visible_to(d.playlists(), d.playlist_users(), 42)


@query(
    "membership_flags",
    ctes("listens", "likes", "playlist_users") + """
    SELECT user_id, track_id, (user_id, track_id) IN (SELECT (user_id, track_id) FROM likes) AS is_liked,
           (user_id, track_id) IN (SELECT (user_id, playlist_id) FROM playlist_users) AS is_subscribed
    FROM listens""",
)
def membership_flags(d):
    pairs = d.listens().select("user_id", "track_id")
    liked = playlists.membership_flags(pairs, d.likes(), ["user_id", "track_id"], "is_liked")
    links = d.playlist_users().select("user_id", F.col("playlist_id").alias("track_id"))
    return playlists.membership_flags(liked, links, ["user_id", "track_id"], "is_subscribed")


ADD_CTES = ctes("playlist_tracks") + """
    , adds AS (SELECT l_orderkey AS playlist_id, l_partkey + 1 AS track_id,
                      CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE o_custkey END AS user_id
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(
    "add_permissions",
    ADD_CTES + """
    SELECT playlist_id, track_id, user_id,
           CASE WHEN track_id NOT IN (SELECT p_partkey FROM part) THEN 'unknown track'
                WHEN user_id <> o_custkey THEN 'not the owner'
                WHEN (playlist_id, track_id) IN (SELECT (playlist_id, track_id) FROM playlist_tracks) THEN 'already in playlist'
                ELSE 'ok' END AS outcome
    FROM adds JOIN orders ON o_orderkey = playlist_id""",
)
def add_permissions(d):
    user = F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")).otherwise(F.col("o_custkey"))
    adds = d.table("lineitem").join(d.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("playlist_id"), (F.col("l_partkey") + 1).alias("track_id"), user.alias("user_id")
    )
    return playlists.check_adds(adds, d.playlist_users(), d.playlist_tracks(), d.tracks(release=False))


@query(
    "new_subscriptions",
    ctes("playlists", "playlist_users") + """
    SELECT DISTINCT l_partkey AS playlist_id, l_suppkey AS user_id FROM lineitem
    WHERE l_partkey IN (SELECT playlist_id FROM playlists WHERE is_public)
      AND NOT EXISTS (SELECT 1 FROM playlist_users u WHERE u.playlist_id = l_partkey AND u.user_id = l_suppkey)""",
)
def new_subscriptions(d):
    wanted = d.table("lineitem").select(
        F.col("l_partkey").alias("playlist_id"), F.col("l_suppkey").alias("user_id")
    )
    return playlists.new_subscriptions(wanted, d.playlists(), d.playlist_users())


# -- deletes ---------------------------------------------------------------------------------


def _deleted_users(d):
    return d.users().where("nation_id = 3").select("user_id")


def _deleted_playlists(d):
    return d.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("playlist_id"))


@query(
    "delete_propagation",
    ctes("likes") + "SELECT * FROM likes WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
)
def delete_propagation(d):
    return history.drop_users(d.likes(), _deleted_users(d))


@query(
    "delete_user_links",
    ctes("playlist_users")
    + "SELECT * FROM playlist_users WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
)
def delete_user_links(d):
    return playlists.drop_users(d.playlist_users(), _deleted_users(d))


@query(
    "delete_playlist_cascade",
    ctes("playlist_tracks") + """
    SELECT * FROM playlist_tracks
    WHERE playlist_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def delete_playlist_cascade(d):
    return playlists.drop_playlists(d.playlist_tracks(), _deleted_playlists(d))


@query(
    "affected_counts",
    ctes("likes") + """
    SELECT c_custkey AS user_id, count(l.user_id) AS affected
    FROM customer LEFT JOIN likes l ON l.user_id = c_custkey WHERE c_nationkey = 3 GROUP BY 1""",
)
def affected_counts(d):
    return playlists.affected(d.likes(), _deleted_users(d), "user_id")


# -- order -----------------------------------------------------------------------------------


@query(
    "next_position",
    ctes("playlist_tracks") + "SELECT playlist_id, coalesce(max(position), 0) + 1 AS next_position FROM playlist_tracks GROUP BY 1",
)
def next_position(d):
    return playlists.next_positions(d.playlist_tracks())


@query(
    "reorder_positions",
    ctes("playlist_tracks") + """
    SELECT playlist_id, track_id, added_at,
           row_number() OVER (PARTITION BY playlist_id ORDER BY position, track_id, added_at) - 1 AS position
    FROM playlist_tracks t
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey = t.playlist_id AND l_partkey = t.track_id)""",
)
def reorder_positions(d):
    removals = d.table("lineitem").where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id")
    )
    return playlists.remove_and_renumber(d.playlist_tracks(), removals)


@query(
    "append_positions",
    ctes("playlist_tracks") + """
    , wanted AS (SELECT l_orderkey AS playlist_id, l_partkey + 1 AS track_id, min(l_shipdate) AS added_at
                 FROM lineitem GROUP BY 1, 2)
    , fresh AS (SELECT * FROM wanted w WHERE NOT EXISTS (
                 SELECT 1 FROM playlist_tracks t WHERE t.playlist_id = w.playlist_id AND t.track_id = w.track_id))
    SELECT playlist_id, track_id, added_at,
           m.last + row_number() OVER (PARTITION BY playlist_id ORDER BY added_at, track_id) AS position
    FROM fresh JOIN (SELECT playlist_id, max(position) AS last FROM playlist_tracks GROUP BY 1) m USING (playlist_id)""",
)
def append_positions(d):
    additions = d.playlist_tracks().select("playlist_id", (F.col("track_id") + 1).alias("track_id"), "added_at")
    return playlists.append(d.playlist_tracks(), additions)


# -- history and likes -----------------------------------------------------------------------

HISTORY_CTES = ctes("listens") + """
    , history AS (SELECT user_id, track_id, max("timestamp") AS "timestamp" FROM listens
                  WHERE total_chunks_sent >= 0.5 * total_chunks GROUP BY 1, 2)"""
LIKE_CTES = ctes("likes") + """
    , first_likes AS (SELECT user_id, track_id, min(liked_at) AS liked_at FROM likes GROUP BY 1, 2)"""


@query("counted_listens", ctes("listens") + "SELECT * FROM listens WHERE total_chunks_sent >= 0.5 * total_chunks")
def counted_listens(d):
    return history.counted(d.listens())


@query("history_latest", HISTORY_CTES + "SELECT * FROM history")
def history_latest(d):
    return history.latest(d.listens())


@query(
    "history_page",
    HISTORY_CTES + """SELECT * FROM history WHERE user_id = 42 ORDER BY "timestamp" DESC, track_id LIMIT 10 OFFSET 5""",
)
def history_page(d):
    mine = history.latest(d.listens().where("user_id = 42"))
    return paging.piece(mine, ["-timestamp", "track_id"], 10, 5)


@query(
    "history_page_all",
    HISTORY_CTES + """
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, track_id) AS INTEGER) AS rank
                   FROM history) WHERE rank <= 10""",
)
def history_page_all(d):
    return paging.first_of_each(history.latest(d.listens()), ["user_id"], ["-timestamp", "track_id"], 10)


PAGE_ORDER = ["-timestamp", "user_id", "track_id"]


def _stored_history(d):
    """The history as a table in its page order, so that a range of times prunes it."""
    return freeze(history.latest(d.listens()).orderBy(F.col("timestamp").desc()), "paged-history")


@query(
    "history_pages_by_cursor",
    HISTORY_CTES + """SELECT * FROM history ORDER BY "timestamp" DESC, user_id, track_id LIMIT 100 OFFSET 700""",
)
def history_pages_by_cursor(d):
    """The eighth page of all listens, newest first, from the table of page starts."""
    return paging.PageStarts.of(_stored_history(d), PAGE_ORDER, 100).page(8)


@query(
    "history_next_page",
    HISTORY_CTES + """SELECT * FROM history ORDER BY "timestamp" DESC, user_id, track_id LIMIT 50 OFFSET 50""",
)
def history_next_page(d):
    """The page after the last row of the first one."""
    rows = _stored_history(d)
    last = paging.next_page(rows, PAGE_ORDER, None, 50).tail(1)[0]
    return paging.next_page(rows, PAGE_ORDER, last.asDict(), 50)


@query("likes_first", LIKE_CTES + "SELECT * FROM first_likes")
def likes_first(d):
    return history.first_likes(d.likes())


@query(
    "likes_page",
    LIKE_CTES + "SELECT * FROM first_likes WHERE user_id = 42 ORDER BY liked_at DESC, track_id LIMIT 10 OFFSET 2",
)
def likes_page(d):
    mine = history.first_likes(d.likes().where("user_id = 42"))
    return paging.piece(mine, ["-liked_at", "track_id"], 10, 2)


@query(
    "likes_page_all",
    LIKE_CTES + """
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY liked_at DESC, track_id) AS INTEGER) AS rank
    FROM first_likes QUALIFY rank <= 10""",
)
def likes_page_all(d):
    return paging.first_of_each(history.first_likes(d.likes()), ["user_id"], ["-liked_at", "track_id"], 10)


@query(
    "likes_accepted",
    LIKE_CTES + "SELECT user_id, track_id + 1000 AS track_id, liked_at FROM first_likes WHERE track_id + 1000 IN (SELECT p_partkey FROM part)",
)
def likes_accepted(d):
    likes = d.likes().withColumn("track_id", F.col("track_id") + 1000)
    return history.accepted_likes(likes, d.tracks(release=False))


@query(
    "listened_pct",
    ctes("listens") + """
    SELECT user_id, track_id, "timestamp", round(100.0 * total_chunks_sent / nullif(total_chunks, 0), 1) AS pct,
           total_chunks_sent >= 0.5 * total_chunks AS counted FROM listens""",
)
def listened_pct(d):
    sent, total = F.col("total_chunks_sent"), F.col("total_chunks")
    return d.listens().select(
        "user_id", "track_id", "timestamp",
        scalars.listened_pct(sent, total).alias("pct"),
        rules.counts_as_listen(sent, total).alias("counted"),
    )
