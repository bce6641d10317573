"""Stateful streams: de-duplication, live metrics, session expiry, enrichment, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.functions.scalars import status_class
from listenlake.operators import history
from listenlake.operators.http import DEFAULT_BOUNDS, bucket_counts, bucket_quantile, windows
from listenlake.operators.sessions import IDLE_SECONDS
from listenlake.operators.sinks import KeyedTable
from listenlake.streaming.pipelines import batch_folder


def deduplicate(events: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """First occurrence of each key; copies within ``lateness`` are dropped."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def daily_counts(rows: DataFrame, ts: str, lateness: str) -> DataFrame:
    return rows.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").cast("date").alias("period"), "n")


def daily_types(events: DataFrame, lateness: str) -> DataFrame:
    """Events per day and type."""
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("date").alias("period"), "event_type", "n")
    )


def daily_chunks(events: DataFrame, lateness: str) -> DataFrame:
    """Chunks sent and acknowledged per day."""
    return (
        events.where(F.col("event_type").isin("SessionStopped", "ChunksAckEvent"))
        .withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("w"))
        .agg(
            F.coalesce(F.sum("total_chunks_sent"), F.lit(0)).alias("sent_chunks"),
            F.coalesce(F.sum("acked_chunk_count"), F.lit(0)).alias("acked_chunks"),
        )
        .select(F.col("w.start").cast("date").alias("period"), "sent_chunks", "acked_chunks")
    )


def daily_users(events: DataFrame, lateness: str) -> DataFrame:
    """Mergeable distinct-user sketch per day (exact counting does not stream)."""
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("w"))
        .agg(F.hll_sketch_agg("user_id").alias("users"))
        .select(F.col("w.start").cast("date").alias("day"), "users")
    )


def expired_sessions(events: DataFrame, key: str, ts: str, lateness: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions ended by silence, each emitted once the watermark has passed its end."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(key, F.session_window(ts, f"{idle_seconds} seconds"))
        .agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("events"))
        .drop("session_window")
    )


def capture_sessions(starts: KeyedTable, path: str):
    """Writer for session events: all of them to a folder per batch, first starts to ``starts``.

    ``starts`` is keyed by session with the version ``first``, which is larger for earlier starts,
    so a start that arrives late still becomes its session's first.
    """
    keep = batch_folder(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        first = F.struct(-F.unix_micros("timestamp"), -F.col("event_id"))
        begun = batch.where(F.col("event_type") == "SessionStarted").groupBy("session_id").agg(
            F.max(first).alias("first"),
            F.max_by(F.struct("user_id", "track_id", "bitrate"), first).alias("start"),
        )
        starts.upsert(begun.select("session_id", "first", "start.*"), batch_id, "starts")
        keep(batch, batch_id)

    return write


def enriched(events: DataFrame, starts: KeyedTable) -> DataFrame:
    """Every captured event, with user, track and starting bitrate of its session's first start.

    The join is made on read, so no event waits for its start, none is dropped for want of one,
    none comes out twice, and a start of any lateness is used.
    """
    known = starts.read().select("session_id", "user_id", "track_id", F.col("bitrate").alias("start_bitrate"))
    return events.drop("user_id", "track_id").join(known, "session_id", "left")


def enriched_live(events: DataFrame, lateness: str, reach: str) -> DataFrame:
    """Every event with each start of its session at most ``reach`` before it, while they stream.

    A left join of two watermarked streams: an event leaves the state once no start within
    ``reach`` can still come, and then comes out with nulls if none did; a start leaves once
    no event can still reach it. So the state holds ``reach`` and ``lateness`` and no more. An
    event with several starts in reach comes out with each; ``latest_start`` keeps the last.
    """
    timed = events.withWatermark("timestamp", lateness)
    # Asked with the time, so that the filter stays above the watermark: events of all types move it.
    started = F.when(F.col("event_type") == "SessionStarted", F.col("timestamp")).isNotNull()
    starts = timed.where(started).select(
        F.col("session_id").alias("_session"),
        F.col("timestamp").alias("started_at"),
        F.col("event_id").alias("start_event"),
        "user_id",
        "track_id",
        F.col("bitrate").alias("start_bitrate"),
    )
    within = (F.col("started_at") <= F.col("timestamp")) & (
        F.col("started_at") >= F.col("timestamp") - F.expr(f"INTERVAL {reach}")
    )
    slim = timed.select("event_id", "session_id", "event_type", "timestamp")
    return slim.join(starts, (F.col("session_id") == F.col("_session")) & within, "left").drop("_session")


def latest_start(rows: DataFrame) -> DataFrame:
    """One row for each event of ``enriched_live``: that with the latest start."""
    start = F.struct("started_at", "start_event", "user_id", "track_id", "start_bitrate")
    return rows.groupBy("event_id", "session_id", "event_type", "timestamp").agg(F.max(start).alias("_start")).select(
        "event_id", "session_id", "event_type", "timestamp", "_start.user_id", "_start.track_id", "_start.start_bitrate"
    )


STATUS_CLASSES = (2, 4, 5)
PANE_SUMS = [f"le_{i}" for i in range(len(DEFAULT_BOUNDS))] + ["total"] + [f"n_{c}xx" for c in STATUS_CLASSES]


def request_panes(requests: DataFrame, lateness: str, slide: str) -> DataFrame:
    """Latency histogram and status counts per endpoint and pane, one slide wide.

    Every request is counted in one pane, however many windows cover it.
    """
    kind = status_class(F.col("status"))
    counts = requests.withWatermark("ts", lateness).groupBy(F.window("ts", slide).alias("w"), "endpoint").agg(
        *bucket_counts(DEFAULT_BOUNDS, F.col("duration_s")),
        *[F.count(F.when(kind == c, 1)).alias(f"n_{c}xx") for c in STATUS_CLASSES],
    )
    return counts.select(F.col("w.start").alias("pane"), "endpoint", *PANE_SUMS)


def windows_of_panes(panes: DataFrame, length: str, slide: str, seconds: int) -> DataFrame:
    """Rates, error share and p95 of windows of ``length`` every ``slide``, summed from panes on read."""
    sums = windows(panes.withColumn("_w", F.struct(F.col("pane").alias("start"))), ["endpoint"], length, slide, PANE_SUMS)
    return sums.select(
        "window_start",
        "endpoint",
        F.round(F.col("total") / seconds, 6).alias("per_second"),
        *[F.round(F.col(f"n_{c}xx") / seconds, 6).alias(f"rate_{c}xx") for c in STATUS_CLASSES],
        F.round(100 * F.col("n_5xx") / F.nullif("total", F.lit(0)), 6).alias("error_pct"),
        F.round(bucket_quantile(0.95, DEFAULT_BOUNDS), 6).alias("p95"),
    )


def request_windows(requests: DataFrame, lateness: str, length: str, slide: str, seconds: int) -> DataFrame:
    """Rate, status split, error share and bucket p95 per endpoint and window."""
    kind = status_class(F.col("status"))
    counts = requests.withWatermark("ts", lateness).groupBy(F.window("ts", length, slide).alias("w"), "endpoint").agg(
        *bucket_counts(DEFAULT_BOUNDS, F.col("duration_s")),
        *[F.count(F.when(kind == c, 1)).alias(f"n_{c}xx") for c in (2, 4, 5)],
    )
    return counts.select(
        F.col("w.start").alias("window_start"),
        "endpoint",
        F.round(F.col("total") / seconds, 6).alias("per_second"),
        *[F.round(F.col(f"n_{c}xx") / seconds, 6).alias(f"rate_{c}xx") for c in (2, 4, 5)],
        F.round(100 * F.col("n_5xx") / F.nullif("total", F.lit(0)), 6).alias("error_pct"),
        F.round(bucket_quantile(0.95, DEFAULT_BOUNDS), 6).alias("p95"),
    )


def request_counter(requests: DataFrame) -> DataFrame:
    """Requests by method, endpoint and status since the start."""
    return requests.groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


# -- micro-batch writers -----------------------------------------------------------------


def upsert_into(table: KeyedTable):
    """Writer for aggregates in update mode: the newest value per key wins."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)

    return write


def upsert_history(table: KeyedTable):
    """Writer for listens: counted ones, latest per (user, track) by listen time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(history.latest(batch), batch_id, "listens")

    return write


def record_deletions(deletions: KeyedTable):
    """Writer for user deletions (user_id, timestamp) into a small table of the latest per user.

    The history itself is not touched: ``without_deleted`` applies deletions when it is read,
    so a listen older than its user's deletion stays away however late it arrives.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        deletions.upsert(batch.groupBy("user_id").agg(F.max("timestamp").alias("timestamp")), batch_id, "deletions")

    return write


def without_deleted(rows: DataFrame, deletions: KeyedTable, at: str = "timestamp") -> DataFrame:
    """Rows without those a deletion of their user covers; rows newer than it stay."""
    gone = deletions.read().select("user_id", F.col("timestamp").alias("_deleted_at"))
    kept = F.col("_deleted_at").isNull() | (F.col(at) > F.col("_deleted_at"))
    return rows.join(gone, "user_id", "left").where(kept).drop("_deleted_at")
