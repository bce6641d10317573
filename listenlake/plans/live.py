"""Streams over the given tables, run until all data is processed, then read back."""

from pyspark.sql import functions as F

from listenlake.operators import charts, history
from listenlake.operators.changes import ChangeTable
from listenlake.operators.quality import ddl
from listenlake.operators.sinks import SORT_KEYS, KeyedTable
from listenlake.plans import dashboard, ingest, sessions
from listenlake.plans.http import LOG, P95_SQL, SLIDING
from listenlake.plans.playlists import HISTORY_CTES
from listenlake.plans.registry import query
from listenlake.session import freeze, staging_path
from listenlake.sources import cdc, files
from listenlake.sources.domain import SHARE_FILES, STREAM_FILES, ctes
from listenlake.streaming import live, pipelines
from listenlake.streaming.capture import CaptureTable
from listenlake.streaming.cascade import Cascade
from listenlake.streaming.late import LateSplit
from listenlake.streaming.session_machine import live_states

LATE = "2 days"
LINES_A_FILE = 1 << 17  # rows of a table whose change lines share a file


def _finish(stream_query):
    stream_query.awaitTermination()
    return stream_query


def _append(d, rows, name):
    """Run an append stream to the end and read its output files."""
    out = staging_path(d.spark, name)
    _finish(pipelines.append_files(rows, f"{out}/rows", f"{out}/checkpoint", once=True))
    return d.spark.read.schema(rows.schema).parquet(f"{out}/rows")


def _update(d, rows, name, keys):
    """Run an update-mode stream to the end into a keyed table and read it."""
    out = staging_path(d.spark, name)
    table = KeyedTable(d.spark, f"{out}/rows", keys)
    _finish(pipelines.each_batch(rows, live.upsert_into(table), f"{out}/checkpoint", "update", once=True))
    return table.read()


# -- capture pipelines ---------------------------------------------------------------------


def _land(d, lines, path, table, kind="text"):
    """Write change lines of a table as files of bounded size; returns how many files a batch takes.

    The files grow in number with the table, so no task writes or reads more in a larger one;
    the batches stay STREAM_FILES.
    """
    files = max(STREAM_FILES, -(-d.table(table).count() // LINES_A_FILE))
    lines.repartition(files).write.format(kind).save(path)
    return -(-files // STREAM_FILES)


def _captured(d, table, lines, given):
    """Land change lines as text, stream them through the table's pipeline."""
    out = staging_path(d.spark, f"stream-{table}")
    source = cdc.read_lines(d.spark, f"{out}/topic", _land(d, lines.select("value"), f"{out}/topic", given))
    _finish(pipelines.run_cdc({table: source}, f"{out}/rows", f"{out}/checkpoints", once=True)[table])
    return d.spark.read.parquet(f"{out}/rows/{table}")


@query("stream_cdc_session", ingest.PARSE_SQL)
def stream_cdc_session(d):
    return _captured(d, "session_events", d.cdc_lines(), "events")


@query(
    "stream_cdc_playlist",
    """SELECT l_orderkey * 10 + l_linenumber AS event_id, 'TrackAddedToPlaylist' AS event_type,
              CAST(l_orderkey AS INTEGER) AS playlist_id, CAST(l_partkey AS INTEGER) AS track_id,
              CAST(l_suppkey AS INTEGER) AS user_id, l_shipdate AS "timestamp" FROM lineitem""",
)
def stream_cdc_playlist(d):
    return _captured(d, "playlist_events", d.playlist_cdc_lines(), "lineitem")


@query(
    "stream_cdc_users",
    """SELECT o_orderkey AS event_id, 'UserRegistered' AS event_type, CAST(o_custkey AS VARCHAR) AS user_id,
              o_orderdate AS "timestamp" FROM orders""",
)
def stream_cdc_users(d):
    return _captured(d, "users_events", d.user_cdc_lines(), "orders")


@query("stream_capture_session", ingest.STORED_SQL)
def stream_capture_session(d):
    """Change lines through defaults, day folders and sort key, merged after every third batch."""
    out = staging_path(d.spark, "capture-session")
    files = _land(d, d.cdc_lines().select("value"), f"{out}/topic", "events")
    source = {"session_events": cdc.read_lines(d.spark, f"{out}/topic", files)}
    _finish(pipelines.run_capture(d.spark, source, f"{out}/tables", f"{out}/checkpoints", 3, once=True)["session_events"])
    return pipelines.capture_tables(d.spark, f"{out}/tables")["session_events"].read()


@query("stream_idempotent_sink", ctes("session_events") + "SELECT * FROM session_events")
def stream_idempotent_sink(d):
    """Every batch in its own folder; each batch is written twice on purpose."""
    out = staging_path(d.spark, "stream-batches")
    write = pipelines.batch_folder(f"{out}/rows")

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    _finish(pipelines.each_batch(d.session_events(d.stream("events")), twice, f"{out}/checkpoint", once=True))
    written = d.spark.read.parquet(f"{out}/rows")
    assert written.select("batch_id").distinct().count() > 1
    return written.drop("batch_id")


@query("stream_dedup", "SELECT event_id, ts FROM events")
def stream_dedup(d):
    """Every event is delivered twice; each comes out once."""
    events = d.stream("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _append(d, live.deduplicate(twice, "event_id", "ts", "40 days"), "stream-dedup")


@query("stream_cdc_current_state", ingest.STATE_SQL)
def stream_cdc_current_state(d):
    """The change log in no order over the batches, updates with their changed columns only, each batch twice."""
    out = staging_path(d.spark, "stream-state")
    lines = d.partial_cdc_lines().select("value", "offset")
    files = _land(d, lines, f"{out}/topic", "events", "parquet")
    table = ChangeTable(d.spark, f"{out}/rows", "event_id", cdc.columns(cdc.SESSION_ROW)[1:])
    source = d.spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/topic")

    def twice(batch, batch_id):
        table.write(batch, batch_id)
        table.write(batch, batch_id)

    changes = cdc.partial_changes(source, cdc.SESSION_ROW, "offset")
    _finish(pipelines.each_batch(changes, twice, f"{out}/checkpoint", once=True))
    return table.read().withColumn("timestamp", F.timestamp_micros("timestamp"))


@query("stream_capture_layout", ingest.CAPTURED_SQL)
def stream_capture_layout(d):
    """Captured batches into the defaulted table by day, each twice, merged once in mid-stream."""
    table = CaptureTable(d.spark, staging_path(d.spark, "stream-capture"), SORT_KEYS["session_events"])

    def twice(batch, batch_id):
        table.write(batch, batch_id)
        table.write(batch, batch_id)
        if batch_id == 2:
            table.merge(1)

    rows = d.session_events(d.stream("events", delay=86_400)).withColumn("bitrate", F.col("bitrate").cast("string"))
    _finish(pipelines.each_batch(rows, twice, f"{table.path}/checkpoint", once=True))
    return table.read()


# -- live metrics --------------------------------------------------------------------------


@query("stream_adds_per_day", ctes("playlist_tracks") + "SELECT CAST(added_at AS DATE) AS period, count(*) AS n FROM playlist_tracks GROUP BY 1")
def stream_adds_per_day(d):
    adds = d.stream("lineitem").select(F.col("l_shipdate").cast("timestamp").alias("ts"))
    return _update(d, live.daily_counts(adds, "ts", LATE), "stream-adds", ["period"])


@query(
    "stream_event_types",
    ctes("session_events")
    + """SELECT CAST("timestamp" AS DATE) AS period, event_type, count(*) AS n FROM session_events GROUP BY 1, 2""",
)
def stream_event_types(d):
    rows = live.daily_types(d.session_events(d.stream("events")), LATE)
    return _update(d, rows, "stream-types", ["period", "event_type"])


@query(
    "stream_sent_vs_acked",
    f"SELECT day AS period, sent_chunks, acked_chunks FROM ({dashboard.CHUNKS_SQL})",
)
def stream_sent_vs_acked(d):
    return _update(d, live.daily_chunks(d.session_events(d.stream("events")), LATE), "stream-chunks", ["period"])


@query("stream_user_sketches", dashboard.CLOSE_SQL.format(unit="day", name="day"))
def stream_user_sketches(d):
    events = d.stream("events").select(F.col("ts").cast("timestamp").alias("timestamp"), "user_id")
    sketches = _update(d, live.daily_users(events, LATE), "stream-users", ["day"])
    exact = charts.distinct_users(d.table("events").select(F.col("ts").cast("timestamp").alias("timestamp"), "user_id"))
    return dashboard.closeness(sketches.select("day", F.hll_sketch_estimate("users").alias("estimate")), exact, "day")


@query("stream_late_corrections", "SELECT CAST(ts AS DATE) AS period, count(*) AS n FROM events GROUP BY 1")
def stream_late_corrections(d):
    """Rows arrive up to ten days late, days close after two: late rows are kept and then merged in."""
    split = LateSplit(d.spark, staging_path(d.spark, "stream-late-rows"), "ts", 2 * 86_400)
    events = d.stream("events", delay=10 * 86_400).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    _finish(pipelines.each_batch(events, split.write, f"{split.path}/checkpoint", once=True))
    split.correct(STREAM_FILES)
    return split.corrected_days()


# -- sessions ------------------------------------------------------------------------------


@query(
    "stream_session_expiry",
    f"""SELECT user_id, first_at, last_at, events FROM ({sessions.VISITS_SQL})
    WHERE epoch_us(last_at) + CAST({sessions.IDLE} AS BIGINT) * 1000000
          <= (SELECT epoch_ms(max(ts)) * 1000 - 3600000000 FROM events)""",
)
def stream_session_expiry(d):
    """Visits that ended; those still open at the end of the data are not emitted."""
    events = d.stream("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _append(d, live.expired_sessions(events, "user_id", "ts", "1 hour", sessions.IDLE), "stream-expiry")


@query("stream_enriched", sessions.ENRICHED_SQL)
def stream_enriched(d):
    out = staging_path(d.spark, "stream-enriched")
    starts = KeyedTable(d.spark, f"{out}/starts", ["session_id"], "first")
    write = live.capture_sessions(starts, f"{out}/events")
    _finish(pipelines.each_batch(d.session_events(d.stream("events")), write, f"{out}/checkpoint", once=True))
    return live.enriched(d.spark.read.parquet(f"{out}/events"), starts).select(
        "event_id", "session_id", "event_type", "user_id", "track_id", "start_bitrate"
    )


EXPIRY_SQL = ctes("session_events") + """
    , gaps AS (SELECT *, CASE WHEN epoch_us("timestamp") - epoch_us(lag("timestamp") OVER w) < 1800000000 THEN 0 ELSE 1 END AS opens
               FROM session_events WINDOW w AS (PARTITION BY session_id ORDER BY "timestamp", event_id))
    , parts AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS part,
                CASE event_type WHEN 'SessionStarted' THEN 'STARTED' WHEN 'SessionPaused' THEN 'PAUSED'
                WHEN 'SessionResumed' THEN 'STARTED' WHEN 'SessionStopped' THEN 'STOPPED' END AS r FROM gaps)
    , around AS (SELECT *,
        coalesce(last_value(r IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'NONE') AS state_before,
        coalesce(last_value(r IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'NONE') AS state_after,
        lead(event_id) OVER w IS NULL AS ends
      FROM parts WINDOW w AS (PARTITION BY session_id, part ORDER BY "timestamp", event_id))
    SELECT session_id, event_id, event_type, "timestamp", state_before, state_after,
           CASE event_type WHEN 'SessionStarted' THEN state_before = 'NONE'
                           WHEN 'SessionPaused' THEN state_before = 'STARTED'
                           WHEN 'SessionResumed' THEN state_before = 'PAUSED'
                           ELSE state_before IN ('STARTED', 'PAUSED') END AS legal
    FROM around
    UNION ALL
    SELECT session_id, NULL, 'SessionExpired', "timestamp", state_after, 'STOPPED', true
    FROM around WHERE ends AND state_after IN ('STARTED', 'PAUSED')"""


@query("stream_session_states", EXPIRY_SQL)
def stream_session_states(d):
    """Rows arrive up to a day late; states and expiries are those of event time."""
    events = d.session_events(d.stream("events", close=True, delay=86_400))
    return _append(d, live_states(events, LATE), "stream-states")


# The whole session day is in reach; a later start of the session is preferred to an earlier one.
LIVE_START_SQL = ctes("session_events") + """
    , started AS (SELECT session_id, "timestamp" AS started_at, event_id AS start_event, user_id, track_id, bitrate
                  FROM session_events WHERE event_type = 'SessionStarted')
    SELECT e.event_id, e.session_id, e.event_type, e."timestamp", s.user_id, s.track_id, s.bitrate AS start_bitrate
    FROM session_events e LEFT JOIN started s ON s.session_id = e.session_id
         AND s.started_at <= e."timestamp" AND s.started_at >= e."timestamp" - INTERVAL 6 HOUR
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY s.started_at DESC, s.start_event DESC) = 1"""


@query("stream_enriched_live", LIVE_START_SQL)
def stream_enriched_live(d):
    """Events and starts joined while they stream; those without a start in six hours have nulls."""
    events = d.session_events(d.stream("events", close=True, delay=86_400))
    rows = _append(d, live.enriched_live(events, LATE, "6 HOURS"), "stream-enriched-live")
    return live.latest_start(rows)


# -- history and deletions -------------------------------------------------------------------


def _history(d, part="true", table=None):
    """Counted listens of a part streamed into the history table; returns the table."""
    out = staging_path(d.spark, "stream-history")
    table = table or KeyedTable(d.spark, f"{out}/rows", ["user_id", "track_id"], "timestamp")
    owners = d.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    listens = d.stream("lineitem").where(part).join(owners, "l_orderkey").select(
        "user_id",
        F.col("l_partkey").alias("track_id"),
        F.col("l_quantity").cast("long").alias("total_chunks_sent"),
        F.lit(50).cast("long").alias("total_chunks"),
        F.col("l_shipdate").alias("timestamp"),
    )
    _finish(pipelines.each_batch(listens, live.upsert_history(table), f"{out}/listens", once=True))
    return table, out


@query("stream_history", HISTORY_CTES + "SELECT * FROM history")
def stream_history(d):
    table, _ = _history(d)
    return table.read()


@query(
    "stream_user_deletion",
    HISTORY_CTES + """
    SELECT h.* FROM history h JOIN customer ON c_custkey = user_id
    WHERE NOT (c_mktsegment = 'BUILDING' AND "timestamp" <= TIMESTAMP '1999-01-01')""",
)
def stream_user_deletion(d):
    """Users of one segment are deleted as of a day; what they heard later stays."""
    table, out = _history(d)
    return live.without_deleted(table.read(), _deletions(d, out))


def _deletions(d, out):
    """Deletions of one segment's users, streamed into their own table."""
    deleted = d.stream("customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id"), F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00'").alias("timestamp")
    )
    table = KeyedTable(d.spark, f"{out}/deleted", ["user_id"], "timestamp", "user_id long, timestamp timestamp_ntz")
    assert table.read().isEmpty()
    _finish(pipelines.each_batch(deleted, live.record_deletions(table), f"{out}/deletions", once=True))
    return table


@query(
    "stream_late_listens",
    HISTORY_CTES + """
    SELECT h.* FROM history h JOIN customer ON c_custkey = user_id
    WHERE NOT (c_mktsegment = 'BUILDING' AND "timestamp" <= TIMESTAMP '1999-01-01')""",
)
def stream_late_listens(d):
    """As ``stream_user_deletion``, but all listens arrive after the deletions."""
    out = staging_path(d.spark, "stream-late")
    deletions = _deletions(d, out)
    table, _ = _history(d)
    return live.without_deleted(table.read(), deletions)


@query("stream_history_compacted", HISTORY_CTES + "SELECT * FROM history")
def stream_history_compacted(d):
    """The history is compacted in mid-stream; the rest comes from a query that counts batches anew."""
    table, out = _history(d, "l_linenumber > 3")
    smaller = table.compact(f"{out}/compacted")
    _history(d, "l_linenumber <= 3", smaller)
    return smaller.read()


DELETED = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"
GONE = f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({DELETED})"
LEFT = {
    "history": (HISTORY_CTES, f"SELECT * FROM history WHERE user_id NOT IN ({DELETED})", f"user_id IN ({DELETED})"),
    "likes": (ctes("likes"), f"SELECT * FROM likes WHERE user_id NOT IN ({DELETED})", f"user_id IN ({DELETED})"),
    "playlist_users": (
        ctes("playlist_users"),
        f"SELECT * FROM playlist_users WHERE user_id NOT IN ({DELETED}) AND playlist_id NOT IN ({GONE})",
        f"user_id IN ({DELETED}) OR playlist_id IN ({GONE})",
    ),
    "playlists": (ctes("playlists"), f"SELECT * FROM playlists WHERE playlist_id NOT IN ({GONE})", f"playlist_id IN ({GONE})"),
    "playlist_tracks": (
        ctes("playlist_tracks"), f"SELECT * FROM playlist_tracks WHERE playlist_id NOT IN ({GONE})", f"playlist_id IN ({GONE})"
    ),
}


def _stored_keys(rows, name):
    """A table's keys, written: every batch reads them, what is joined and grouped to make them is done once."""
    kept = freeze(rows.select(*[c for c in ("user_id", "playlist_id") if c in rows.columns]), f"cascade-{name}")
    return lambda: kept


def _cascade(d, counted):
    """Deletions of one segment's users, streamed over all tables; counted ones write each batch twice."""
    owners = d.table("orders").select(F.col("o_orderkey").alias("playlist_id"), F.col("o_custkey").alias("user_id"))
    tables = {
        "history": lambda: history.latest(d.listens()),
        "likes": d.likes,
        "playlist_users": d.playlist_users,
        "playlists": d.playlists,
        "playlist_tracks": d.playlist_tracks,
    }
    if counted:
        tables = {name: _stored_keys(table(), name) for name, table in tables.items()}
    cascade = Cascade(d.spark, staging_path(d.spark, "stream-cascade"), tables if counted else {}, lambda: owners)

    def write(batch, batch_id):
        for _ in range(2 if counted else 1):
            cascade.write(batch, batch_id)

    deleted = d.stream("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    _finish(pipelines.each_batch(deleted, write, f"{cascade.path}/checkpoint", once=True))
    return cascade, tables


def _register_left(name):
    @query(f"stream_cascade_{name}", LEFT[name][0] + LEFT[name][1])
    def left(d):
        cascade, tables = _cascade(d, counted=False)
        return cascade.left(tables[name]())


for _name in LEFT:
    _register_left(_name)


@query(
    "stream_user_cascade",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", (SELECT count(*) FROM ({ctes_} SELECT * FROM {name} WHERE {hit})) AS affected,
        (SELECT count(*) FROM ({ctes_} {left})) AS remaining"""
        for name, (ctes_, left, hit) in LEFT.items()
    ),
)
def stream_user_cascade(d):
    """For every table the rows that all deletions took, by the counts of their batches, and those left."""
    cascade, tables = _cascade(d, counted=True)
    remaining = None
    for name, table in tables.items():
        one = cascade.left(table()).agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(name).alias("table"), "remaining")
        remaining = one if remaining is None else remaining.unionByName(one)
    return cascade.affected().groupBy("table").agg(F.sum("affected").alias("affected")).join(remaining, "table")


# -- requests ------------------------------------------------------------------------------


@query("stream_request_counter", ctes("requests") + "SELECT method, endpoint, status, count(*) AS requests FROM requests GROUP BY 1, 2, 3")
def stream_request_counter(d):
    rows = live.request_counter(d.requests(d.stream("events")))
    return _update(d, rows, "stream-counter", ["method", "endpoint", "status"])


@query(
    "stream_request_windows",
    f"""SELECT window_start, endpoint, per_second, rate_2xx, rate_4xx, rate_5xx, error_pct, latency AS p95
    FROM (SELECT time_bucket(INTERVAL 5 minute, ts) AS window_start, endpoint, round(count(*) / 300.0, 6) AS per_second,
                 round(count(*) FILTER (status // 100 = 2) / 300.0, 6) AS rate_2xx,
                 round(count(*) FILTER (status // 100 = 4) / 300.0, 6) AS rate_4xx,
                 round(count(*) FILTER (status // 100 = 5) / 300.0, 6) AS rate_5xx,
                 round(100.0 * count(*) FILTER (status // 100 = 5) / count(*), 6) AS error_pct
          FROM ({ctes("requests")} SELECT * FROM requests) GROUP BY 1, 2)
    JOIN ({P95_SQL}) USING (window_start, endpoint)""",
)
def stream_request_windows(d):
    rows = live.request_windows(d.requests(d.stream("events")), LATE, "5 minutes", "5 minutes", 300)
    return _update(d, rows, "stream-windows", ["window_start", "endpoint"])


SLIDING_P95_SQL = P95_SQL.replace(P95_SQL[P95_SQL.index(", placed AS"):P95_SQL.index(", buckets AS")], SLIDING[SLIDING.index(", placed AS") :].format(steps=5) + "\n    ")


@query(
    "stream_request_sliding",
    f"""SELECT window_start, endpoint, per_second, rate_2xx, rate_4xx, rate_5xx, error_pct, latency AS p95
    FROM (SELECT window_start, endpoint, round(count(*) / 300.0, 6) AS per_second,
                 round(count(*) FILTER (status // 100 = 2) / 300.0, 6) AS rate_2xx,
                 round(count(*) FILTER (status // 100 = 4) / 300.0, 6) AS rate_4xx,
                 round(count(*) FILTER (status // 100 = 5) / 300.0, 6) AS rate_5xx,
                 round(100.0 * count(*) FILTER (status // 100 = 5) / count(*), 6) AS error_pct
          FROM ({SLIDING.format(steps=5)} SELECT * FROM placed) GROUP BY 1, 2)
    JOIN ({SLIDING_P95_SQL}) USING (window_start, endpoint)""",
)
def stream_request_sliding(d):
    """Five-minute windows by the minute, from panes of a minute that the stream keeps."""
    panes = _update(d, live.request_panes(d.requests(d.stream("events")), LATE, "1 minute"), "stream-panes", ["pane", "endpoint"])
    return live.windows_of_panes(panes, "5 minutes", "1 minute", 300)


@query(
    "stream_request_minutes",
    ctes("requests") + """
    SELECT date_trunc('minute', ts) AS window_start, endpoint, round(count(*) / 60.0, 6) AS per_second,
           round(count(*) FILTER (status // 100 = 5) / 60.0, 6) AS rate_5xx FROM requests GROUP BY 1, 2""",
)
def stream_request_minutes(d):
    """Rates by the minute from the same panes."""
    panes = _update(d, live.request_panes(d.requests(d.stream("events")), LATE, "1 minute"), "stream-panes", ["pane", "endpoint"])
    return live.windows_of_panes(panes, "1 minute", "1 minute", 60).select("window_start", "endpoint", "per_second", "rate_5xx")


def _log_rows(d, name):
    """Log files streamed into one table with a folder for lines that cannot be counted, in one pass."""
    out = staging_path(d.spark, name)
    rows = files.stream_request_log(d.spark, d.landed_requests(), SHARE_FILES).withColumn("aside", F.col("problem").isNotNull())
    _finish(pipelines.each_batch(rows, pipelines.batch_folder(f"{out}/rows", ["aside"]), f"{out}/checkpoint", once=True))
    return d.spark.read.schema(f"{ddl(rows)}, batch_id long").parquet(f"{out}/rows")


@query(
    "stream_request_log",
    LOG + """
    SELECT date_trunc('hour', ts) AS hour, method, endpoint, status, count(*) AS requests
    FROM log WHERE problem IS NULL GROUP BY 1, 2, 3, 4""",
)
def stream_request_log(d):
    rows = _log_rows(d, "stream-log").where("NOT aside").withColumn("hour", F.date_trunc("hour", "ts"))
    return rows.groupBy("hour", "method", "endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


@query("stream_request_problems", LOG + "SELECT problem, count(*) AS n FROM log WHERE problem IS NOT NULL GROUP BY 1")
def stream_request_problems(d):
    rows = _log_rows(d, "stream-problems").where("aside")
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
