"""Dashboard charts as registered queries."""

import datetime as dt

from pyspark.sql import functions as F

from listenlake.functions import rules, scalars
from listenlake.operators import charts, sessions
from listenlake.plans.registry import query
from listenlake.sources.domain import ctes

TOP_SQL = """SELECT {key}, count(*) AS n FROM {view} GROUP BY {key} ORDER BY n DESC, {key} LIMIT 10"""


@query("top_tracks", ctes("playlist_tracks") + TOP_SQL.format(key="track_id", view="playlist_tracks"))
def top_tracks(d):
    return charts.top_k(d.playlist_events(users=False), "track_id")


@query("top_users", ctes("playlist_events") + TOP_SQL.format(key="user_id", view="playlist_events"))
def top_users(d):
    return charts.top_k(d.playlist_events(), "user_id")


@query("top_playlists", ctes("playlist_tracks") + TOP_SQL.format(key="playlist_id", view="playlist_tracks"))
def top_playlists(d):
    return charts.top_k(d.playlist_events(users=False), "playlist_id")


@query(
    "topk_ascending",
    ctes("playlist_tracks")
    + f"SELECT * FROM ({TOP_SQL.format(key='track_id', view='playlist_tracks')}) ORDER BY n, track_id DESC",
)
def topk_ascending(d):
    return charts.top_k_ascending(d.playlist_events(users=False), "track_id")


@query(
    "adds_per_day",
    ctes("playlist_tracks")
    + "SELECT CAST(added_at AS DATE) AS period, count(*) AS n FROM playlist_tracks GROUP BY 1",
)
def adds_per_day(d):
    return charts.rows_per_period(d.playlist_events(users=False), "timestamp")


@query(
    "event_type_distribution",
    ctes("session_events") + """
    SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM session_events
    WHERE event_type IN ('SessionStarted', 'SessionPaused', 'OffsetChangedEvent',
                         'SessionStopped', 'SessionResumed', 'BitrateChangedEvent')
    GROUP BY event_type""",
)
def event_type_distribution(d):
    return charts.event_distribution(d.session_events())


USERS_SQL = """
    SELECT CAST(date_trunc('{unit}', "timestamp") AS DATE) AS period, count(DISTINCT {user}) AS users
    FROM {view} GROUP BY 1"""
EVENT_USERS = """WITH all_events AS (SELECT ts AS "timestamp", user_id FROM events)"""


def _all_events(d):
    return d.table("events").select(F.col("ts").alias("timestamp"), "user_id")


@query("dau", EVENT_USERS + USERS_SQL.format(unit="day", user="user_id", view="all_events"))
def dau(d):
    return charts.distinct_users(_all_events(d))


@query("mau", EVENT_USERS + USERS_SQL.format(unit="month", user="user_id", view="all_events"))
def mau(d):
    return charts.distinct_users(_all_events(d), "P1M")


@query("yau", EVENT_USERS + USERS_SQL.format(unit="year", user="user_id", view="all_events"))
def yau(d):
    return charts.distinct_users(_all_events(d), "P1Y")


@query("dau_session_events", ctes("session_events") + USERS_SQL.format(unit="day", user="user_id", view="session_events"))
def dau_session_events(d):
    return charts.distinct_users(d.session_events())


@query(
    "dau_compat",
    ctes("session_events")
    + USERS_SQL.format(unit="day", user="coalesce(CAST(user_id AS VARCHAR), '')", view="session_events"),
)
def dau_compat(d):
    return charts.distinct_users(d.session_events(), compat_empty=True)


# Sketch estimates are approximate: the exact count comes beside whether the estimate is within a twentieth.
CLOSE_SQL = """SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS {name}, count(DISTINCT user_id) AS users, TRUE AS close FROM events GROUP BY 1"""


def closeness(estimates, exact, name):
    """``name, users, close``: exact counts, and whether the estimate is within 5 % of them (or one user)."""
    near = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), 0.05 * F.col("users"))
    counts = exact.select(F.col("period").alias(name), "users")
    return counts.join(estimates, name, "full").select(name, "users", F.coalesce(near, F.lit(False)).alias("close"))


@query("mau_from_sketches", CLOSE_SQL.format(unit="month", name="period"))
def mau_from_sketches(d):
    events = _all_events(d)
    found = charts.approx_users(charts.user_sketches(events), "P1M").withColumnRenamed("users", "estimate")
    return closeness(found, charts.distinct_users(events, "P1M"), "period")


@query(
    "avg_session_minutes",
    ctes("session_events") + """
    SELECT CAST(started AS DATE) AS day,
           round(avg((epoch_us(stopped) - epoch_us(started)) / 60000000.0), 4) AS avg_minutes,
           count(*) AS sessions
    FROM (SELECT session_id,
                 min("timestamp") FILTER (event_type = 'SessionStarted') AS started,
                 max("timestamp") FILTER (event_type = 'SessionStopped') AS stopped
          FROM session_events GROUP BY session_id)
    WHERE stopped >= started GROUP BY 1""",
)
def avg_session_minutes(d):
    return charts.session_minutes(d.session_events())


CHUNKS_SQL = ctes("session_events") + """
    SELECT CAST("timestamp" AS DATE) AS day,
           CAST(coalesce(sum(total_chunks_sent), 0) AS BIGINT) AS sent_chunks,
           CAST(coalesce(sum(acked_chunk_count), 0) AS BIGINT) AS acked_chunks,
           round(coalesce(sum(acked_chunk_count), 0) / nullif(coalesce(sum(total_chunks_sent), 0), 0), 6) AS ack_ratio
    FROM session_events WHERE event_type IN ('SessionStopped', 'ChunksAckEvent') GROUP BY 1"""


@query("sent_vs_acked", CHUNKS_SQL)
def sent_vs_acked(d):
    return charts.chunks_per_day(d.session_events())


@query(
    "track_funnel",
    ctes("session_events", "listens", "likes", "playlist_tracks") + """
    , s AS (SELECT track_id, count(*) AS starts FROM session_events
            WHERE event_type = 'SessionStarted' GROUP BY 1)
    , h AS (SELECT track_id, count(*) AS listens, count(DISTINCT user_id) AS listeners FROM listens
            WHERE total_chunks_sent >= 0.5 * total_chunks GROUP BY 1)
    , l AS (SELECT track_id, count(*) AS likes FROM likes GROUP BY 1)
    , a AS (SELECT track_id, count(*) AS adds FROM playlist_tracks GROUP BY 1)
    SELECT track_id, coalesce(starts, 0) AS starts, coalesce(listens, 0) AS listens,
           coalesce(listeners, 0) AS listeners, coalesce(likes, 0) AS likes, coalesce(adds, 0) AS adds
    FROM s FULL JOIN h USING (track_id) FULL JOIN l USING (track_id) FULL JOIN a USING (track_id)""",
)
def track_funnel(d):
    starts = d.session_events().where(F.col("event_type") == "SessionStarted")
    return charts.track_funnel(starts, d.listens(), d.likes(), d.playlist_tracks())


@query(
    "search_log_summary",
    """WITH log AS (SELECT ts, md5('{"k":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || ',"query":"'
                            || event_type || '"}') AS fingerprint FROM events)
    SELECT CAST(ts AS DATE) AS day, count(*) AS searches, count(DISTINCT fingerprint) AS requests
    FROM log GROUP BY 1""",
)
def search_log_summary(d):
    return charts.search_days(_search_log(d))


@query(
    "top_searches",
    """WITH log AS (SELECT md5('{"k":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || ',"query":"'
                            || event_type || '"}') AS fingerprint FROM events)
    SELECT fingerprint, count(*) AS n FROM log GROUP BY 1 ORDER BY n DESC, fingerprint LIMIT 10""",
)
def top_searches(d):
    return charts.top_k(_search_log(d), "fingerprint")


def _search_log(d):
    log = d.table("events").select(
        "ts", F.col("event_type").alias("query"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    return log.withColumn("fingerprint", scalars.fingerprint(["query", "k"]))


@query(
    "wide_series",
    ctes("session_events") + """
    SELECT CAST("timestamp" AS DATE) AS day,
           round(avg(total_chunks_sent), 6) AS sent, round(avg(acked_chunk_count), 6) AS acked
    FROM session_events WHERE event_type IN ('SessionStopped', 'ChunksAckEvent') GROUP BY 1""",
)
def wide_series(d):
    stops_and_acks = d.session_events().where(F.col("event_type").isin("SessionStopped", "ChunksAckEvent"))
    long = stops_and_acks.select(
        F.col("timestamp").cast("date").alias("day"),
        F.when(F.col("event_type") == "SessionStopped", "sent").otherwise("acked").alias("metric"),
        F.coalesce("total_chunks_sent", "acked_chunk_count").alias("value"),
    )
    wide = charts.wide_series(long, "day", "metric", "value", ["sent", "acked"])
    return wide.select("day", F.round("sent", 6).alias("sent"), F.round("acked", 6).alias("acked"))


BEHAVIOUR_SQL = ctes("session_events") + """
    SELECT session_id,
           count(*) FILTER (event_type = 'SessionPaused') AS pauses,
           count(*) FILTER (event_type = 'SessionResumed') AS resumes,
           count(*) FILTER (event_type = 'OffsetChangedEvent') AS seeks,
           count(*) FILTER (event_type = 'BitrateChangedEvent') AS switches,
           CAST(coalesce(sum(new_chunk_offset - old_chunk_offset), 0) AS BIGINT) AS net_seek,
           CAST(coalesce(sum(abs(new_chunk_offset - old_chunk_offset)), 0) AS BIGINT) AS absolute_seek,
           CAST(arg_max(coalesce(new_bitrate, bitrate), (epoch_us("timestamp"), event_id))
                FILTER (coalesce(new_bitrate, bitrate) IS NOT NULL) AS INTEGER) AS last_bitrate
    FROM session_events GROUP BY session_id"""


@query("session_behaviour", BEHAVIOUR_SQL)
def session_behaviour(d):
    return sessions.behaviour(d.session_events(), ["session_id"])


@query(
    "track_behaviour",
    ctes("session_events") + """
    , started AS (SELECT session_id, track_id, row_number() OVER (PARTITION BY session_id
                  ORDER BY "timestamp", event_id) AS rn FROM session_events WHERE event_type = 'SessionStarted')
    SELECT s.track_id,
           count(*) FILTER (event_type = 'SessionPaused') AS pauses,
           count(*) FILTER (event_type = 'SessionResumed') AS resumes,
           count(*) FILTER (event_type = 'OffsetChangedEvent') AS seeks,
           count(*) FILTER (event_type = 'BitrateChangedEvent') AS switches,
           CAST(coalesce(sum(new_chunk_offset - old_chunk_offset), 0) AS BIGINT) AS net_seek,
           CAST(coalesce(sum(abs(new_chunk_offset - old_chunk_offset)), 0) AS BIGINT) AS absolute_seek,
           CAST(arg_max(coalesce(new_bitrate, bitrate), (epoch_us("timestamp"), event_id))
                FILTER (coalesce(new_bitrate, bitrate) IS NOT NULL) AS INTEGER) AS last_bitrate
    FROM session_events e LEFT JOIN started s ON s.session_id = e.session_id AND rn = 1 GROUP BY s.track_id""",
)
def track_behaviour(d):
    return sessions.behaviour(sessions.enrich(d.session_events()), ["track_id"])


# -- filters over the event tables -------------------------------------------------------


@query(
    "time_range",
    """SELECT event_id, event_type, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""",
)
def time_range(d):
    inside = rules.time_range("ts", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))
    return d.table("events").where(inside).select("event_id", "event_type", "ts")
