"""Playback-session analytics over the sparse event log.

Events of a session are ordered by (timestamp, event_id): some events carry the session's
start time, and event_id is the order in which rows were logged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.operators import ordered
from listenlake.operators.machine import Machine, fold
from listenlake.operators.ordered import OrderedRows

ORDER = ["timestamp", "event_id"]
IDLE_SECONDS = 1800

# The state each event leads to, and the states it may be applied in.
STATE_AFTER = {
    "SessionStarted": "STARTED",
    "SessionPaused": "PAUSED",
    "SessionResumed": "STARTED",
    "SessionStopped": "STOPPED",
}
ALLOWED_BEFORE = {
    "SessionStarted": ["NONE"],
    "SessionPaused": ["STARTED"],
    "SessionResumed": ["PAUSED"],
    "SessionStopped": ["STARTED", "PAUSED"],
    "ChunksAckEvent": ["STARTED", "PAUSED"],
    "BitrateChangedEvent": ["STARTED", "PAUSED"],
    "OffsetChangedEvent": ["STARTED", "PAUSED"],
}
# An event makes its move only where it is allowed.
STRICT = Machine(
    ("NONE", "STARTED", "PAUSED", "STOPPED"),
    {event: {state: after for state in ALLOWED_BEFORE[event]} for event, after in STATE_AFTER.items()},
)


def _rows(events: DataFrame) -> OrderedRows:
    return OrderedRows.of(events, ["session_id"], ORDER)


def starts(events: DataFrame) -> DataFrame:
    """First start row of each session: its user, track and bitrate."""
    return (
        events.where(F.col("event_type") == "SessionStarted")
        .groupBy("session_id")
        .agg(
            F.min_by(F.struct("user_id", "track_id", "bitrate"), F.struct(*ORDER)).alias("start"),
        )
        .select("session_id", "start.*")
    )


def enrich(events: DataFrame) -> DataFrame:
    """Give every event the user, track and starting bitrate of its session."""
    return events.drop("user_id", "track_id").join(
        starts(events).withColumnRenamed("bitrate", "start_bitrate"), "session_id", "left"
    )


def timeline(events: DataFrame) -> DataFrame:
    """Ordinal, neighbouring events and gaps in seconds."""
    rows = _rows(events.select("session_id", "event_id", "event_type", "timestamp")).add(
        ordinal=ordered.row_number(),
        previous_event=ordered.previous(F.col("event_type")),
        next_event=ordered.following(F.col("event_type")),
        previous_at=ordered.previous(F.col("timestamp")),
    )
    gap = (F.unix_micros("timestamp") - F.unix_micros("previous_at")) / 1_000_000
    return rows.frame().withColumn("gap_seconds", F.round(gap, 3)).drop("previous_at")


def effective_bitrate(events: DataFrame) -> DataFrame:
    """Bitrate in force at each event: the start value, then the last switch."""
    slim = events.select("session_id", "event_id", "event_type", "timestamp", "bitrate", "new_bitrate")
    return (
        _rows(slim)
        .add(effective_bitrate=ordered.last_seen(F.coalesce("new_bitrate", "bitrate")))
        .frame()
        .drop("bitrate", "new_bitrate")
    )


def bitrate_at_acks(events: DataFrame) -> DataFrame:
    """The bitrate in force when each acknowledgement arrived."""
    acks = effective_bitrate(events).where(F.col("event_type") == "ChunksAckEvent")
    return acks.select("session_id", "event_id", "timestamp", "effective_bitrate")


def _case(value: Column, mapping: dict, wrap=F.lit) -> Column:
    chosen = None
    for key, result in mapping.items():
        chosen = F.when(value == key, wrap(result)) if chosen is None else chosen.when(value == key, wrap(result))
    return chosen


def states(events: DataFrame) -> DataFrame:
    """State before and after each event, and whether the event was legal there.

    A start leads to STARTED, a pause to PAUSED, a resume to STARTED, a stop to STOPPED;
    other events keep the state. Illegal events are flagged and still move the state to
    where they point, so one missing row does not flag the rest of the session.
    """
    slim = events.select("session_id", "event_id", "event_type", "timestamp")
    reached = _case(F.col("event_type"), STATE_AFTER)
    rows = _rows(slim).add(
        _before=ordered.last_before(reached),
        state_after=ordered.last_seen(reached),
    )
    before = F.coalesce("_before", F.lit("NONE"))
    allowed = _case(F.col("event_type"), ALLOWED_BEFORE, lambda v: F.array(*[F.lit(s) for s in v]))
    return (
        rows.frame()
        .withColumn("state_before", before)
        .withColumn("state_after", F.coalesce("state_after", F.lit("NONE")))
        .withColumn("legal", F.array_contains(allowed, F.col("state_before")))
        .drop("_before")
    )


def strict_states(events: DataFrame) -> DataFrame:
    """State before and after each event where illegal events are ignored.

    A start only opens a session that has not begun, a pause needs a started session, a resume
    a paused one, and nothing follows a stop. Illegal events are flagged and leave the state.
    """
    rows = _rows(events.select("session_id", "event_id", "event_type", "timestamp"))
    allowed = _case(F.col("event_type"), ALLOWED_BEFORE, lambda v: F.array(*[F.lit(s) for s in v]))
    return (
        fold(rows, STRICT, "event_type", "state_before", "state_after")
        .frame()
        .withColumn("legal", F.array_contains(allowed, F.col("state_before")))
    )


TRACK = "struct<track_id: long, available_bitrates: array<int>, total_chunks: bigint, duration_ms: bigint>"


def snapshot_timeline(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """What is known of the session after each of its events, and whether the event was applied.

    Illegal events change nothing (see ``strict_states``), and neither does a switch to a bitrate
    that the session's track does not have; both are flagged as not ``applied``. A session's
    user, track and first bitrate are those of the start that opened it. The current chunk is the
    last seek's target plus the chunks acknowledged since. ``paused_at`` is cleared by a resume
    and kept by a stop. ``tracks`` has one row a track: ``track_id, available_bitrates,
    total_chunks, duration_ms``; a track it lacks has no bitrates, so all switches are refused.
    """
    slim = events.select(
        "session_id", *ORDER, "event_type", "user_id", "track_id", "bitrate", "new_bitrate",
        "acked_chunk_count", "new_chunk_offset",
    )
    known = tracks.select(F.struct(*[c.split(":")[0] for c in TRACK[7:-1].split(", ")]).cast(TRACK).alias("_track"))
    # Only starts have a track; the other rows would all meet on its null.
    is_start = F.col("event_type").eqNullSafe("SessionStarted")
    starting = slim.where(is_start).join(known, F.col("track_id") == F.col("_track.track_id"), "left")
    given = slim.where(~is_start).withColumn("_track", F.lit(None).cast(TRACK)).unionByName(starting)

    allowed = _case(F.col("event_type"), ALLOWED_BEFORE, lambda v: F.array(*[F.lit(s) for s in v]))
    legal = F.coalesce(F.array_contains(allowed, F.col("state_before")), F.lit(False))

    def when(event_type: str, value: Column) -> Column:
        return F.when(F.col("_legal") & (F.col("event_type") == event_type), value)

    opening = F.struct("user_id", "track_id", "bitrate", F.col("timestamp").alias("started_at"), "_track")
    switch = F.coalesce(F.array_contains("_open._track.available_bitrates", F.col("new_bitrate")), F.lit(False))
    refused = (F.col("event_type") == "BitrateChangedEvent") & ~switch
    rows = fold(_rows(given), STRICT, "event_type", "state_before", "status").map(lambda df: df.withColumn("_legal", legal))
    rows = rows.add(
        _open=ordered.last_seen(when("SessionStarted", opening)),
        _acks=ordered.running_sum(F.coalesce(when("ChunksAckEvent", F.col("acked_chunk_count")), F.lit(0))),
        _pause=ordered.last_seen(
            F.coalesce(
                when("SessionPaused", F.struct(F.col("timestamp").alias("at"))),
                when("SessionResumed", F.struct(F.lit(None).cast("timestamp").alias("at"))),
            )
        ),
        finished_at=ordered.last_seen(when("SessionStopped", F.col("timestamp"))),
    ).map(lambda df: df.withColumn("applied", F.col("_legal") & F.coalesce(~refused, F.lit(True))))
    rows = rows.add(
        _sought=ordered.last_seen(when("OffsetChangedEvent", F.col("new_chunk_offset") - F.col("_acks"))),
        current_bitrate=ordered.last_seen(
            F.coalesce(when("SessionStarted", F.col("bitrate")), when("BitrateChangedEvent", F.when(switch, F.col("new_bitrate"))))
        ),
    )
    return rows.frame().select(
        "session_id", *ORDER, "event_type", "applied", "status",
        "_open.user_id", "_open.track_id", "_open.started_at", "current_bitrate",
        (F.coalesce("_sought", F.lit(0)) + F.col("_acks")).alias("current_chunk"),
        F.col("_pause.at").alias("paused_at"),
        "finished_at",
        F.col("_open._track").alias("track"),
    )


def snapshots(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """The last snapshot of each session that has begun, and how many switches it refused."""
    rows = snapshot_timeline(events, tracks)
    fields = [c for c in rows.columns if c not in ("session_id", *ORDER, "event_type", "applied")]
    refused = F.count_if(
        (F.col("event_type") == "BitrateChangedEvent") & ~F.col("applied") & F.col("status").isin("STARTED", "PAUSED")
    )
    last = F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("_last")
    return rows.groupBy("session_id").agg(last, refused.alias("refused_switches")).select(
        "session_id", "_last.*", "refused_switches"
    ).where(F.col("status") != "NONE")


def snapshot_struct(chunk_size: int) -> Column:
    """A row of ``snapshots`` as the struct that is stored, with times in ISO form."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    return F.struct(
        "session_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.col("current_bitrate").cast("string").alias("current_bitrate"),
        F.lit(chunk_size).alias("chunk_size"),
        "status",
        F.col("current_chunk").cast("int").alias("current_chunk"),
        iso("started_at"),
        F.struct(
            F.col("track_id").cast("string").alias("track_id"),
            F.col("track.total_chunks").alias("total_chunks"),
            F.col("track.available_bitrates").cast("array<string>").alias("available_bitrates"),
            F.col("track.duration_ms").alias("duration_ms"),
        ).alias("track"),
        iso("paused_at"),
        iso("finished_at"),
    )


def sessionize(
    events: DataFrame, key: str, ts: str, tie: str, idle_seconds: int = IDLE_SECONDS
) -> DataFrame:
    """Cut each key's events into visits separated by at least ``idle_seconds`` of silence."""
    rows = OrderedRows.of(events, [key], [ts, tie]).add(_previous=ordered.previous(F.col(ts)))
    idle = F.unix_micros(ts) - F.unix_micros("_previous") >= idle_seconds * 1_000_000
    opens = F.when(F.col("_previous").isNull() | idle, 1).otherwise(0)
    return rows.add(visit=ordered.running_sum(opens)).frame().drop("_previous")


def visits(events: DataFrame, key: str, ts: str, tie: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """One row per visit: first and last event and the number of events."""
    return (
        sessionize(events.select(key, ts, tie), key, ts, tie, idle_seconds)
        .groupBy(key, "visit")
        .agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("events"))
    )


def listening_time(events: DataFrame) -> DataFrame:
    """Pauses and seconds listened net of pauses, per session.

    Time runs from a start or resume to the next start, pause, resume or stop; a pause lasts
    to the next of these. A state with no later event counts nothing.
    """
    marks = events.where(F.col("event_type").isin(*STATE_AFTER)).select(
        "session_id", "event_id", "event_type", "timestamp"
    )
    rows = _rows(marks).add(_next=ordered.following(F.col("timestamp"))).frame()
    seconds = (F.unix_micros("_next") - F.unix_micros("timestamp")) / 1_000_000
    playing = F.col("event_type").isin("SessionStarted", "SessionResumed")
    paused = F.col("event_type") == "SessionPaused"
    return rows.groupBy("session_id").agg(
        F.round(F.coalesce(F.sum(F.when(playing, seconds)), F.lit(0.0)), 3).alias("listened_seconds"),
        F.round(F.coalesce(F.sum(F.when(paused, seconds)), F.lit(0.0)), 3).alias("paused_seconds"),
        F.count(F.when(paused, 1)).alias("pauses"),
    )


def behaviour(events: DataFrame, keys: list[str]) -> DataFrame:
    """Pause, seek and bitrate-switch behaviour per key."""

    def count(event_type: str, name: str) -> Column:
        return F.count(F.when(F.col("event_type") == event_type, 1)).alias(name)

    seek = F.col("new_chunk_offset") - F.col("old_chunk_offset")
    rate = F.coalesce("new_bitrate", "bitrate")
    return events.groupBy(*keys).agg(
        count("SessionPaused", "pauses"),
        count("SessionResumed", "resumes"),
        count("OffsetChangedEvent", "seeks"),
        count("BitrateChangedEvent", "switches"),
        F.coalesce(F.sum(seek), F.lit(0)).alias("net_seek"),
        F.coalesce(F.sum(F.abs(seek)), F.lit(0)).alias("absolute_seek"),
        F.max_by(rate, F.when(rate.isNotNull(), F.struct(*ORDER))).alias("last_bitrate"),
    )
