"""Session timelines, states, visits and the column functions around playback."""

from pyspark.sql import functions as F

from listenlake.functions import scalars
from listenlake.operators import catalog, sessions
from listenlake.plans.registry import query
from listenlake.sources.domain import ctes

S = ctes("session_events")
W = 'WINDOW w AS (PARTITION BY session_id ORDER BY "timestamp", event_id)'
IDLE = 12 * 3600


@query(
    "session_timeline",
    S + f"""
    SELECT session_id, event_id, event_type, "timestamp", row_number() OVER w AS ordinal,
           lag(event_type) OVER w AS previous_event, lead(event_type) OVER w AS next_event,
           round((epoch_us("timestamp") - epoch_us(lag("timestamp") OVER w)) / 1000000.0, 3) AS gap_seconds
    FROM session_events {W}""",
)
def session_timeline(d):
    return sessions.timeline(d.session_events())


ENRICHED_SQL = S + """
    , started AS (SELECT session_id, user_id, track_id, bitrate, row_number() OVER
                  (PARTITION BY session_id ORDER BY "timestamp", event_id) AS rn
                  FROM session_events WHERE event_type = 'SessionStarted')
    SELECT e.event_id, e.session_id, e.event_type, s.user_id, s.track_id, s.bitrate AS start_bitrate
    FROM session_events e LEFT JOIN started s ON s.session_id = e.session_id AND rn = 1"""


@query("session_enriched", ENRICHED_SQL)
def session_enriched(d):
    return sessions.enrich(d.session_events()).select(
        "event_id", "session_id", "event_type", "user_id", "track_id", "start_bitrate"
    )


EFFECTIVE = S + """
    , effective AS (SELECT session_id, event_id, event_type, "timestamp",
        last_value(coalesce(new_bitrate, bitrate) IGNORE NULLS) OVER (PARTITION BY session_id
            ORDER BY "timestamp", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective_bitrate
      FROM session_events)"""


@query("effective_bitrate", EFFECTIVE + " SELECT * FROM effective")
def effective_bitrate(d):
    return sessions.effective_bitrate(d.session_events())


@query(
    "bitrate_at_acks",
    EFFECTIVE + """ SELECT session_id, event_id, "timestamp", effective_bitrate FROM effective
    WHERE event_type = 'ChunksAckEvent'""",
)
def bitrate_at_acks(d):
    return sessions.bitrate_at_acks(d.session_events())


STATES_SQL = S + """
    , reached AS (SELECT *, CASE event_type WHEN 'SessionStarted' THEN 'STARTED' WHEN 'SessionPaused' THEN 'PAUSED'
                  WHEN 'SessionResumed' THEN 'STARTED' WHEN 'SessionStopped' THEN 'STOPPED' END AS r FROM session_events)
    , around AS (SELECT *,
        coalesce(last_value(r IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'NONE') AS state_before,
        coalesce(last_value(r IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'NONE') AS state_after
      FROM reached WINDOW w AS (PARTITION BY session_id ORDER BY "timestamp", event_id))
    SELECT session_id, event_id, event_type, "timestamp", state_before, state_after,
           CASE event_type WHEN 'SessionStarted' THEN state_before = 'NONE'
                           WHEN 'SessionPaused' THEN state_before = 'STARTED'
                           WHEN 'SessionResumed' THEN state_before = 'PAUSED'
                           ELSE state_before IN ('STARTED', 'PAUSED') END AS legal
    FROM around"""


@query("session_state", STATES_SQL)
def session_state(d):
    return sessions.states(d.session_events())


# Step by step: the state an event meets decides whether it moves.
STRICT_SQL = S.replace("WITH", "WITH RECURSIVE", 1) + """
    , numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", event_id) AS place FROM session_events)
    , walk AS (
        SELECT session_id, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS event_id, '' AS event_type,
               CAST(NULL AS TIMESTAMP) AS "timestamp", '' AS state_before, 'NONE' AS state_after
        FROM numbered WHERE place = 1
      UNION ALL
        SELECT n.session_id, n.place, n.event_id, n.event_type, n."timestamp", w.state_after,
               CASE WHEN n.event_type = 'SessionStarted' AND w.state_after = 'NONE' THEN 'STARTED'
                    WHEN n.event_type = 'SessionPaused' AND w.state_after = 'STARTED' THEN 'PAUSED'
                    WHEN n.event_type = 'SessionResumed' AND w.state_after = 'PAUSED' THEN 'STARTED'
                    WHEN n.event_type = 'SessionStopped' AND w.state_after IN ('STARTED', 'PAUSED') THEN 'STOPPED'
                    ELSE w.state_after END
        FROM walk w JOIN numbered n ON n.session_id = w.session_id AND n.place = w.place + 1)
    SELECT session_id, event_id, event_type, "timestamp", state_before, state_after,
           CASE event_type WHEN 'SessionStarted' THEN state_before = 'NONE'
                           WHEN 'SessionPaused' THEN state_before = 'STARTED'
                           WHEN 'SessionResumed' THEN state_before = 'PAUSED'
                           ELSE state_before IN ('STARTED', 'PAUSED') END AS legal
    FROM walk WHERE place > 0"""


@query("session_state_strict", STRICT_SQL)
def session_state_strict(d):
    return sessions.strict_states(d.session_events())


VISITS = f"""
    WITH gaps AS (SELECT user_id, event_id, ts,
            CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= CAST({IDLE} AS BIGINT) * 1000000 THEN 1 ELSE 0 END AS opens
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    , numbered AS (SELECT user_id, event_id, ts, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit FROM gaps)"""


def _events(d):
    return d.table("events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))


@query("sessionize", VISITS + " SELECT user_id, event_id, ts, visit FROM numbered")
def sessionize(d):
    return sessions.sessionize(_events(d), "user_id", "ts", "event_id", IDLE)


VISITS_SQL = VISITS + """
    SELECT user_id, visit, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM numbered GROUP BY 1, 2"""


@query("visits", VISITS_SQL)
def visits(d):
    return sessions.visits(_events(d), "user_id", "ts", "event_id", IDLE)


# The same visits from Spark's own session window, which merges partial sessions.
@query("visits_session_window", VISITS_SQL.replace("user_id, visit, min", "user_id, min").replace("1, 2", "user_id, visit"))
def visits_session_window(d):
    windowed = _events(d).groupBy("user_id", F.session_window("ts", f"{IDLE} seconds")).agg(
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("events")
    )
    return windowed.drop("session_window")


@query(
    "listening_time",
    S + """
    , marks AS (SELECT session_id, event_type, (epoch_us(lead("timestamp") OVER (PARTITION BY session_id
                ORDER BY "timestamp", event_id)) - epoch_us("timestamp")) / 1000000.0 AS secs
                FROM session_events
                WHERE event_type IN ('SessionStarted', 'SessionPaused', 'SessionResumed', 'SessionStopped'))
    SELECT session_id,
           round(coalesce(sum(secs) FILTER (event_type IN ('SessionStarted', 'SessionResumed')), 0), 3) AS listened_seconds,
           round(coalesce(sum(secs) FILTER (event_type = 'SessionPaused'), 0), 3) AS paused_seconds,
           count(*) FILTER (event_type = 'SessionPaused') AS pauses
    FROM marks GROUP BY session_id""",
)
def listening_time(d):
    return sessions.listening_time(d.session_events())


@query(
    "seek_distance",
    S + """
    SELECT event_id, new_chunk_offset - old_chunk_offset AS distance,
           CASE WHEN new_chunk_offset > old_chunk_offset THEN 'forward'
                WHEN new_chunk_offset < old_chunk_offset THEN 'back' ELSE 'none' END AS direction
    FROM session_events WHERE event_type = 'OffsetChangedEvent'""",
)
def seek_distance(d):
    seeks = d.session_events().where("event_type = 'OffsetChangedEvent'")
    distance = scalars.seek_distance(F.col("new_chunk_offset"), F.col("old_chunk_offset"))
    return seeks.select("event_id", distance.alias("distance")).withColumn(
        "direction", scalars.seek_direction(F.col("distance"))
    )


@query(
    "status_map",
    """SELECT event_id, CASE inner_status WHEN 'PAUSED' THEN 'PAUSED' WHEN 'STOPPED' THEN 'STOPPED' ELSE 'ACTIVE' END AS status
    FROM (SELECT event_id, ['STARTED', 'PAUSED', 'STOPPED', 'SHOULD_RESTART', 'ARTIFICIAL_CHUNK'][
              CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1] AS inner_status FROM events)""",
)
def status_map(d):
    inner = F.array(*[F.lit(s) for s in ("STARTED", "PAUSED", "STOPPED", "SHOULD_RESTART", "ARTIFICIAL_CHUNK")])
    k = F.get_json_object("props", "$.k").cast("int")
    return d.table("events").select(
        "event_id", scalars.public_status(F.element_at(inner, k % 5 + 1)).alias("status")
    )


@query(
    "chunk_math",
    """SELECT doc_id AS track_id, (n_chars + 511) // 512 AS chunks,
           round(n_chars * 8 / (rate * 1000.0), 9) AS seconds,
           CAST(round(n_chars * 8 / (rate * 1000.0) * 1000) AS BIGINT) AS duration_ms,
           round((n_chars // 2) / (rate * 1000 / 8.0), 9) AS half_seconds,
           greatest(0, least(CAST(floor((n_chars // 2) / (rate * 1000 / 8.0) * 40000.0) AS BIGINT), n_chars * 2 - 1)) AS switched,
           (n_chars // 2) // 512 AS half_chunk
       FROM (SELECT doc_id, n_chars, CASE doc_id % 3 WHEN 0 THEN 128 WHEN 1 THEN 192 ELSE 320 END AS rate FROM documents)""",
)
def chunk_math(d):
    size, rate = F.col("length"), scalars.object_bitrate(F.col("path"))
    half = F.floor(size / 2)
    return d.objects().select(
        scalars.object_track(F.col("path")).alias("track_id"),
        scalars.total_chunks(size, 512).alias("chunks"),
        F.round(scalars.estimated_seconds(size, rate), 9).alias("seconds"),
        scalars.duration_ms(scalars.estimated_seconds(size, rate)).alias("duration_ms"),
        F.round(scalars.offset_seconds(half, rate), 9).alias("half_seconds"),
        scalars.carried_offset(half, rate, F.lit(320), size * 2).alias("switched"),
        scalars.chunk_number(half, 512).alias("half_chunk"),
    )


@query(
    "fingerprint",
    ctes("tracks") + """
    SELECT track_id, md5('{"explicit":' || CASE WHEN explicit THEN 'true' ELSE 'false' END || ',"max_dur":null,"title":"' || title || '"}') AS digest,
           'search:title=' || title || ':page=' || track_id AS cache_key FROM tracks""",
)
def fingerprint(d):
    rows = d.tracks(release=False).withColumn("max_dur", F.lit(None).cast("int"))
    return rows.select(
        "track_id",
        scalars.fingerprint(["title", "explicit", "max_dur"]).alias("digest"),
        scalars.cache_key("search:title=%s:page=%d", F.col("title"), F.col("track_id")).alias("cache_key"),
    )


@query(
    "sentinels_to_null",
    """SELECT event_id, nullif(CASE WHEN k < 20 THEN '' ELSE event_type END, '') AS title,
              nullif(k % 4, 0) AS min_duration, coalesce(nullif(k % 3, 0), 1) AS page,
              coalesce(nullif(k // 10, 0), 50) AS page_size, CASE WHEN k % 2 = 0 THEN 1 END AS genres
       FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
)
def sentinels_to_null(d):
    k = F.get_json_object("props", "$.k").cast("int")
    page, size = scalars.page_defaults(k % 3, F.floor(k / 10).cast("int"))
    genres = F.when(k % 2 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return d.table("events").select(
        "event_id",
        scalars.sentinel_to_null(F.when(k < 20, "").otherwise(F.col("event_type")), "").alias("title"),
        scalars.sentinel_to_null(k % 4, 0).alias("min_duration"),
        page.alias("page"),
        size.alias("page_size"),
        F.size(scalars.empty_to_null(genres)).alias("genres"),
    )


@query(
    "session_json",
    S + """
    SELECT event_id, session_id AS session_id, '{"session_id":"' || session_id || '","current_bitrate":"' || bitrate
           || '","status":"STARTED","track":{"track_id":"' || track_id || '","available_bitrates":["320","128"]}}' AS snapshot,
           CAST(track_id AS VARCHAR) AS track_back
    FROM session_events WHERE event_type = 'SessionStarted'""",
)
def session_json(d):
    starts = d.session_events().where("event_type = 'SessionStarted'")
    snapshot = F.struct(
        "session_id",
        F.lit(None).cast("string").alias("user_id"),
        F.col("bitrate").cast("string").alias("current_bitrate"),
        F.lit("STARTED").alias("status"),
        F.struct(
            F.col("track_id").cast("string").alias("track_id"),
            F.array(F.lit("320"), F.lit("128")).alias("available_bitrates"),
        ).alias("track"),
        F.lit(None).cast("string").alias("paused_at"),
    )
    text = scalars.snapshot_json(snapshot)
    back = scalars.snapshot_from_json(text)
    return starts.select(
        "event_id", back["session_id"].alias("session_id"), text.alias("snapshot"), back["track"]["track_id"].alias("track_back")
    )


# Tracks as their stored objects give them: every track has one object, and so one bitrate.
SNAPSHOT_SQL = STRICT_SQL.replace("SELECT session_id, event_id, event_type, \"timestamp\", state_before, state_after,\n           CASE event_type", ", states AS (SELECT walk.*, CASE event_type").replace(
    "FROM walk WHERE place > 0",
    """FROM walk WHERE place > 0)
    , events_known AS (SELECT states.*, s.user_id, s.track_id, s.bitrate, s.new_bitrate, s.acked_chunk_count, s.new_chunk_offset
                       FROM states JOIN session_events s USING (event_id))
    , opened AS (SELECT session_id, user_id, track_id, bitrate, "timestamp" AS started_at, doc_id AS known,
                        CASE doc_id % 3 WHEN 0 THEN 128 WHEN 1 THEN 192 WHEN 2 THEN 320 END AS has, n_chars
                 FROM events_known LEFT JOIN documents ON doc_id = track_id WHERE event_type = 'SessionStarted' AND legal)
    , after AS (SELECT e.*, o.has FROM events_known e JOIN opened o USING (session_id) WHERE legal)
    , sought AS (SELECT session_id, max(place) AS seek FROM after WHERE event_type = 'OffsetChangedEvent' GROUP BY 1)
    , facts AS (
        SELECT session_id, arg_max(state_after, place) AS status,
               arg_max(new_bitrate, place) FILTER (event_type = 'BitrateChangedEvent' AND new_bitrate = has) AS switched,
               count(*) FILTER (event_type = 'BitrateChangedEvent' AND new_bitrate IS DISTINCT FROM has) AS refused,
               arg_max(event_type, place) FILTER (event_type IN ('SessionPaused', 'SessionResumed')) AS last_mark,
               max("timestamp") FILTER (event_type = 'SessionPaused') AS paused,
               max("timestamp") FILTER (event_type = 'SessionStopped') AS finished,
               coalesce(sum(acked_chunk_count) FILTER (event_type = 'ChunksAckEvent' AND place > coalesce(seek, 0)), 0)
               + coalesce(max(new_chunk_offset) FILTER (place = seek), 0) AS chunk
        FROM after LEFT JOIN sought USING (session_id) GROUP BY 1)
    SELECT session_id, CAST(user_id AS VARCHAR) AS user_id, CAST(coalesce(switched, bitrate) AS VARCHAR) AS current_bitrate,
           CAST(512 AS INTEGER) AS chunk_size, status, CAST(chunk AS INTEGER) AS current_chunk,
           strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') AS started_at, CAST(track_id AS VARCHAR) AS track_id,
           CAST((n_chars + 511) // 512 AS BIGINT) AS total_chunks, CAST(has AS VARCHAR) AS available_bitrates,
           CAST(round(n_chars * 8 / (has * 1000.0) * 1000) AS BIGINT) AS duration_ms,
           CASE WHEN last_mark = 'SessionPaused' THEN strftime(paused, '%Y-%m-%dT%H:%M:%S.%f') END AS paused_at,
           strftime(finished, '%Y-%m-%dT%H:%M:%S.%f') AS finished_at, refused AS refused_switches
    FROM facts JOIN opened USING (session_id)""",
)


@query("session_snapshots", SNAPSHOT_SQL)
def session_snapshots(d):
    """Every session's snapshot, written as JSON and read back."""
    path, length = F.col("path"), F.col("length")
    objects = d.objects()
    sizes = objects.groupBy(scalars.object_track(path).alias("track_id")).agg(
        F.max(scalars.total_chunks(length, 512)).alias("total_chunks"),
        F.max(scalars.duration_ms(scalars.estimated_seconds(length, scalars.object_bitrate(path)))).alias("duration_ms"),
    )
    tracks = catalog.available_bitrates(objects).withColumnRenamed("bitrates", "available_bitrates").join(sizes, "track_id")
    found = sessions.snapshots(d.session_events(), tracks)
    text = scalars.snapshot_json(sessions.snapshot_struct(512))
    back = found.select(scalars.snapshot_from_json(text).alias("s"), "refused_switches")
    return back.select(
        "s.session_id", "s.user_id", "s.current_bitrate", "s.chunk_size", "s.status", "s.current_chunk", "s.started_at",
        "s.track.track_id", "s.track.total_chunks",
        F.nullif(F.concat_ws(",", "s.track.available_bitrates"), F.lit("")).alias("available_bitrates"),
        "s.track.duration_ms", "s.paused_at", "s.finished_at", "refused_switches",
    )
