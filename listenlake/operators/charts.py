"""Dashboard metrics over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions import scalars
from listenlake.functions.rules import counts_as_listen

# Fixed value: the event types the distribution chart counts.
CHARTED_EVENTS = [
    "SessionStarted", "SessionPaused", "OffsetChangedEvent",
    "SessionStopped", "SessionResumed", "BitrateChangedEvent",
]


def top_k(adds: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Most frequent keys, ties by key. Counts are combined before the shuffle."""
    return (
        adds.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(key))
        .limit(k)
    )


def top_k_ascending(adds: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The top k, shown from the least to the most frequent."""
    return top_k(adds, key, k).orderBy(F.asc("n"), F.desc(key))


def rows_per_period(df: DataFrame, ts: str, grain: str = "P1D") -> DataFrame:
    return df.groupBy(scalars.grain(F.col(ts), grain).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def event_distribution(events: DataFrame, types: list[str] = CHARTED_EVENTS) -> DataFrame:
    """Count and share per event type, most frequent first."""
    counts = events.where(F.col("event_type").isin(types)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    # The window runs over at most len(types) rows.
    return counts.withColumn(
        "share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)
    ).orderBy(F.desc("n"), "event_type")


def distinct_users(events: DataFrame, grain: str = "P1D", compat_empty: bool = False) -> DataFrame:
    """Distinct users per period.

    ``compat_empty`` counts a missing user as one more user, as a store that writes '' for
    null would.
    """
    user: Column = F.col("user_id")
    if compat_empty:
        user = F.coalesce(user.cast("string"), F.lit(""))
    return events.groupBy(scalars.grain(F.col("timestamp"), grain).alias("period")).agg(
        F.countDistinct(user).alias("users")
    )


def user_sketches(events: DataFrame) -> DataFrame:
    """One mergeable distinct-user sketch per day."""
    return events.groupBy(scalars.grain(F.col("timestamp"), "P1D").alias("day")).agg(
        F.hll_sketch_agg("user_id").alias("users")
    )


def approx_users(sketches: DataFrame, grain: str) -> DataFrame:
    """Distinct users per period from day sketches, without reading the events again."""
    return sketches.groupBy(scalars.grain(F.col("day"), grain).alias("period")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users")
    )


def session_minutes(events: DataFrame) -> DataFrame:
    """Average session length in minutes by start day.

    First start to last stop of each session; sessions lacking either, or stopping before
    they start, are left out.
    """
    bounds = events.where(F.col("event_type").isin("SessionStarted", "SessionStopped")).groupBy(
        "session_id"
    ).agg(
        F.min(F.when(F.col("event_type") == "SessionStarted", F.col("timestamp"))).alias("started"),
        F.max(F.when(F.col("event_type") == "SessionStopped", F.col("timestamp"))).alias("stopped"),
    )
    minutes = (F.unix_micros("stopped") - F.unix_micros("started")) / 60_000_000
    return (
        bounds.where(F.col("stopped") >= F.col("started"))
        .groupBy(F.col("started").cast("date").alias("day"))
        .agg(F.round(F.avg(minutes), 4).alias("avg_minutes"), F.count(F.lit(1)).alias("sessions"))
    )


def chunks_per_day(events: DataFrame, at: str = "timestamp") -> DataFrame:
    """Chunks sent and acknowledged per day, and the acknowledged share.

    Some events carry their session's start time; name an ingest-time column in ``at`` to
    count by arrival instead.
    """
    sums = (
        events.where(F.col("event_type").isin("SessionStopped", "ChunksAckEvent"))
        .groupBy(F.col(at).cast("date").alias("day"))
        .agg(
            F.coalesce(F.sum("total_chunks_sent"), F.lit(0)).alias("sent_chunks"),
            F.coalesce(F.sum("acked_chunk_count"), F.lit(0)).alias("acked_chunks"),
        )
    )
    ratio = F.col("acked_chunks") / F.nullif(F.col("sent_chunks"), F.lit(0))
    return sums.withColumn("ack_ratio", F.round(ratio, 6))


def track_funnel(starts: DataFrame, listens: DataFrame, likes: DataFrame, adds: DataFrame) -> DataFrame:
    """Starts, counted listens, listeners, likes and playlist adds per track.

    Each fact is tagged and reduced to (track, user) sums first, so one track with most of
    the rows is combined before the shuffle; no joins between facts are needed.
    """
    def fact(df: DataFrame, name: str, user: Column | None = None) -> DataFrame:
        user = F.lit(None).cast("long") if user is None else user
        return df.select("track_id", F.lit(name).alias("fact"), user.alias("listener"))

    counted = listens.where(counts_as_listen(F.col("total_chunks_sent"), F.col("total_chunks")))
    facts = (
        fact(starts, "start")
        .unionByName(fact(counted, "listen", F.col("user_id")))
        .unionByName(fact(likes, "like"))
        .unionByName(fact(adds, "add"))
        .where(F.col("track_id").isNotNull())
    )
    per_listener = facts.groupBy("track_id", "listener").agg(
        *[F.count(F.when(F.col("fact") == f, 1)).alias(f) for f in ("start", "listen", "like", "add")]
    )
    return per_listener.groupBy("track_id").agg(
        F.sum("start").alias("starts"),
        F.sum("listen").alias("listens"),
        F.count("listener").alias("listeners"),
        F.sum("like").alias("likes"),
        F.sum("add").alias("adds"),
    )


def search_days(searches: DataFrame) -> DataFrame:
    """Searches and distinct requests per day of a search log (ts, fingerprint)."""
    return searches.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("searches"), F.countDistinct("fingerprint").alias("requests")
    )


def wide_series(long: DataFrame, x: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One row per x, one column per listed metric, the mean where several values meet."""
    return long.groupBy(x).pivot(metric, metrics).agg(F.avg(value))
