"""Ingest, change-log and sink queries."""

from pyspark.sql import functions as F

from listenlake.functions import scalars
from listenlake.functions.rules import valid_email
from listenlake.operators import changes, quality, sinks
from listenlake.plans.catalogue import CATALOG_CTES, documents
from listenlake.plans.registry import query
from listenlake.session import freeze, staging_path
from listenlake.sources import cdc, files, wire
from listenlake.sources.domain import ctes

S = ctes("session_events")
LOGGED = S + """
    , after_image AS (
        SELECT *, 0 AS step FROM session_events
        UNION ALL
        SELECT * REPLACE (320 AS bitrate, 1 AS acked_chunk_count), 1 FROM session_events WHERE track_id < 50)"""
ROW = """event_id, event_type, session_id, CAST(user_id AS VARCHAR) AS user_id, CAST(track_id AS VARCHAR) AS track_id,
         CAST(bitrate AS VARCHAR) AS bitrate, new_bitrate, acked_chunk_count, total_chunks_sent,
         new_chunk_offset, old_chunk_offset, "timestamp" """
PARSE_SQL = LOGGED + f"SELECT {ROW} FROM after_image"


@query("cdc_parse", PARSE_SQL)
def cdc_parse(d):
    return cdc.parse(d.cdc_lines(), cdc.SESSION_ROW)


# Parsed rows as the captured table keeps them.
STORED_SQL = f"""
    SELECT event_id, coalesce(event_type, '') AS event_type, coalesce(session_id, '') AS session_id,
           coalesce(user_id, '') AS user_id, coalesce(track_id, '') AS track_id, coalesce(bitrate, '') AS bitrate,
           coalesce(new_bitrate, 0) AS new_bitrate, coalesce(acked_chunk_count, 0) AS acked_chunk_count,
           coalesce(total_chunks_sent, 0) AS total_chunks_sent, coalesce(new_chunk_offset, 0) AS new_chunk_offset,
           coalesce(old_chunk_offset, 0) AS old_chunk_offset, date_trunc('second', "timestamp") AS "timestamp",
           CAST("timestamp" AS DATE) AS event_date FROM ({PARSE_SQL})"""


STATE_SQL = LOGGED + f"""
    , newest AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY step DESC) AS rn FROM after_image)
    SELECT {ROW} FROM newest WHERE rn = 1 AND coalesce(track_id, 0) < 90"""


@query("cdc_current_state", STATE_SQL)
def cdc_current_state(d):
    state = changes.current_state(cdc.changes(d.cdc_lines(), cdc.SESSION_ROW), "event_id", "offset")
    return state.withColumn("timestamp", scalars.from_micros(F.col("timestamp")))


@query(
    "audit_log",
    S + """
    SELECT event_id, event_id * 4 + 1 AS "offset", field_name, old_value, new_value FROM (
        SELECT event_id, 'bitrate' AS field_name, CAST(bitrate AS VARCHAR) AS old_value, '320' AS new_value
        FROM session_events WHERE track_id < 50
        UNION ALL
        SELECT event_id, 'acked_chunk_count', CAST(acked_chunk_count AS VARCHAR), '1' FROM session_events WHERE track_id < 50)
    WHERE old_value IS DISTINCT FROM new_value""",
)
def audit_log(d):
    log = cdc.changes(d.cdc_lines(), cdc.SESSION_ROW)
    return changes.audit_log(log, "event_id", "offset", [c for c in cdc.columns(cdc.SESSION_ROW) if c != "event_id"])


@query(
    "canonical_ids",
    S + """
    SELECT event_id, TRY_CAST(raw AS BIGINT) AS user_id,
           CASE WHEN raw IS NOT NULL AND TRY_CAST(raw AS BIGINT) IS NULL THEN 'user_id' END AS problem
    FROM (SELECT event_id, CASE WHEN track_id < 10 THEN 'user-' || user_id ELSE CAST(user_id AS VARCHAR) END AS raw FROM session_events)""",
)
def canonical_ids(d):
    text = d.session_events().select(
        "event_id",
        F.when(F.col("track_id") < 10, F.concat(F.lit("user-"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("user_id"),
    )
    return cdc.canonical_ids(text, ["user_id"])


# -- wire messages -----------------------------------------------------------------------------


def _messages(d):
    """The session events as wire messages, with the record time of the log."""
    rows = d.session_events().withColumns(
        {c: F.col(c).cast("string") for c in ("user_id", "track_id", "bitrate")}
    )
    return wire.encode(rows).withColumn("timestamp", F.timestamp_micros(F.lit(0)))


WIRE_ROW = """event_type, session_id, CAST(user_id AS VARCHAR) AS user_id, CAST(track_id AS VARCHAR) AS track_id,
         CAST(bitrate AS VARCHAR) AS bitrate, CAST(new_bitrate AS BIGINT) AS new_bitrate,
         CAST(acked_chunk_count AS BIGINT) AS acked_chunk_count, CAST(total_chunks_sent AS BIGINT) AS total_chunks_sent,
         CAST(new_chunk_offset AS BIGINT) AS new_chunk_offset, CAST(old_chunk_offset AS BIGINT) AS old_chunk_offset, "timestamp" """


@query("protobuf_decode", S + f"SELECT {WIRE_ROW} FROM session_events")
def protobuf_decode(d):
    return wire.typed_union(wire.decode(_messages(d)))


@query(
    "typed_union",
    S + f"SELECT {WIRE_ROW} FROM session_events",
)
def typed_union(d):
    """Each event type's own columns, the others null, in one scan."""
    text = d.session_events().withColumns({f: F.col(f).cast("string") for f in wire.TEXT_FIELDS if f in d.session_events().columns})
    whole = text.withColumns({f: F.col(f).cast("long") for f in wire.INT_FIELDS if f in text.columns})
    return wire.typed_union(whole.withColumn("problem", F.lit(None).cast("string")))


@query(
    "decode_problems",
    S + """
    SELECT CASE WHEN event_id % 7 = 0 THEN 'missing header' WHEN event_id % 7 = 1 THEN 'unknown type'
                WHEN event_id % 7 = 2 THEN 'bad payload' ELSE 'ok' END AS outcome, count(*) AS n
    FROM session_events GROUP BY 1""",
)
def decode_problems(d):
    """Every message is decoded; some are damaged first, by their number."""
    decoded = wire.decode(_damaged(d))
    return decoded.groupBy(F.coalesce("problem", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _damaged(d):
    rows = d.session_events().withColumns({c: F.col(c).cast("string") for c in ("user_id", "track_id", "bitrate")})
    turn = F.col("timestamp_id") % 7
    numbered = wire.encode(rows.withColumn("session_id", F.concat_ws("|", "session_id", "event_id"))).withColumn(
        "timestamp_id", F.regexp_extract(F.col("key").cast("string"), r"\|([0-9]+)$", 1).cast("long")
    )
    unknown = F.array(F.struct(F.lit(wire.HEADER).alias("key"), F.lit("Nothing").cast("binary").alias("value")))
    return numbered.select(
        "key",
        F.when(turn == 2, F.lit("ÿÿÿ").cast("binary")).otherwise(F.col("value")).alias("value"),
        F.when(turn == 0, F.slice("headers", 1, 0)).when(turn == 1, unknown).otherwise(F.col("headers")).alias("headers"),
        F.timestamp_micros(F.lit(0)).alias("timestamp"),
    )


@query(
    "decode_quarantine",
    S + """
    SELECT event_id, event_id % 7 < 3 AS aside, CASE WHEN event_id % 7 > 2 THEN event_type END AS event_type,
           CASE event_id % 7 WHEN 0 THEN 'missing header' WHEN 1 THEN 'unknown type' WHEN 2 THEN 'bad payload' END AS problem
    FROM session_events""",
)
def decode_quarantine(d):
    """Messages that cannot be read go to a side table with the reason, the others on."""
    good, bad = quality.set_aside(wire.decode(_damaged(d)), "problem", staging_path(d.spark, "undecoded"))
    number = F.regexp_extract(F.col("key").cast("string"), r"\|([0-9]+)$", 1).cast("long").alias("event_id")
    nothing = F.lit(None).cast("string")
    return good.select(number, F.lit(False).alias("aside"), "event_type", nothing.alias("problem")).unionByName(
        bad.select(number, F.lit(True).alias("aside"), nothing.alias("event_type"), "problem")
    )


@query(
    "quarantined",
    ctes("users") + """
    SELECT 'bad' AS side, user_id FROM users WHERE NOT regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$')
    UNION ALL
    SELECT 'good', user_id FROM users WHERE regexp_matches(email, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$')""",
)
def quarantined(d):
    good, bad = quality.quarantine(d.users(), {"email": valid_email(F.col("email"))})
    return good.select(F.lit("good").alias("side"), "user_id").unionByName(
        bad.select(F.lit("bad").alias("side"), "user_id")
    )


# -- listings and logs -------------------------------------------------------------------------


@query(
    "objects_list",
    ctes("objects") + """
    SELECT path, length, CAST(regexp_extract(path, '([0-9]+)/[^/]+\\.mp3$', 1) AS BIGINT) AS track_id,
           CAST(regexp_extract(path, '/([0-9]+)\\.mp3$', 1) AS INTEGER) AS bitrate FROM objects""",
)
def objects_list(d):
    return files.object_rows(d.objects())


@query(
    "requests_normalised",
    ctes("requests") + """
    SELECT request_id, method, status, coalesce(CASE WHEN status <> 404 THEN '/api/' || endpoint END, '/raw/' || request_id) AS endpoint
    FROM requests""",
)
def requests_normalised(d):
    raw = d.requests().select(
        "request_id", "method", "status",
        F.when(F.col("status") != 404, F.concat(F.lit("/api/"), "endpoint")).alias("route"),
        F.concat(F.lit("/raw/"), "request_id").alias("path"),
    )
    return files.normalise_requests(raw)


@query(
    "status_class",
    ctes("requests") + "SELECT request_id, status // 100 AS class FROM requests WHERE status // 100 IN (4, 5)",
)
def status_class(d):
    kind = scalars.status_class(F.col("status"))
    return d.requests().where(kind.isin(4, 5)).select("request_id", kind.alias("class"))


# -- sinks -------------------------------------------------------------------------------------


@query(
    "sink_defaults",
    S + """
    SELECT event_id, event_type, session_id, coalesce(user_id, 0) AS user_id, coalesce(track_id, 0) AS track_id,
           coalesce(CAST(bitrate AS VARCHAR), '') AS bitrate, coalesce(new_bitrate, 0) AS new_bitrate,
           coalesce(acked_chunk_count, 0) AS acked_chunk_count, coalesce(total_chunks_sent, 0) AS total_chunks_sent,
           coalesce(new_chunk_offset, 0) AS new_chunk_offset, coalesce(old_chunk_offset, 0) AS old_chunk_offset,
           date_trunc('second', "timestamp") AS "timestamp" FROM session_events""",
)
def sink_defaults(d):
    rows = d.session_events().withColumn("bitrate", F.col("bitrate").cast("string"))
    return sinks.to_seconds(sinks.with_sink_defaults(rows))


CAPTURED_SQL = f"""SELECT *, CAST("timestamp" AS DATE) AS event_date FROM ({S}
    SELECT event_id, event_type, session_id, coalesce(user_id, 0) AS user_id, coalesce(track_id, 0) AS track_id,
           coalesce(CAST(bitrate AS VARCHAR), '') AS bitrate, coalesce(new_bitrate, 0) AS new_bitrate,
           coalesce(acked_chunk_count, 0) AS acked_chunk_count, coalesce(total_chunks_sent, 0) AS total_chunks_sent,
           coalesce(new_chunk_offset, 0) AS new_chunk_offset, coalesce(old_chunk_offset, 0) AS old_chunk_offset,
           date_trunc('second', "timestamp") AS "timestamp" FROM session_events)"""


@query("sink_layout_roundtrip", S + """SELECT *, CAST("timestamp" AS DATE) AS event_date FROM session_events""")
def sink_layout_roundtrip(d):
    path = staging_path(d.spark, "session-events")
    sinks.write_events(d.session_events(), path, sinks.SORT_KEYS["session_events"])
    return d.spark.read.parquet(path)


UPSERT_SQL = CATALOG_CTES + """
    SELECT track_id, CASE WHEN explicit THEN title || ' (edited)' ELSE title END AS title, duration_ms
    FROM tracks WHERE duration_ms < 400000"""


@query("upsert_docs", UPSERT_SQL)
def upsert_docs(d):
    """Index all documents, rewrite the explicit ones, delete the long ones."""
    table = sinks.KeyedTable(d.spark, staging_path(d.spark, "documents"), ["track_id"])
    docs = freeze(documents(d).select("track_id", "title", "duration_ms", "explicit"), "upserted")
    table.upsert(docs.drop("explicit"), 0)
    edited = docs.where("explicit").withColumn("title", F.concat("title", F.lit(" (edited)")))
    table.upsert(edited.drop("explicit"), 1)
    long = docs.where("duration_ms >= 400000").drop("explicit")
    table.change(long, F.lit(True), 2)
    return table.read()


@query("upsert_compacted", UPSERT_SQL)
def upsert_compacted(d):
    table = sinks.KeyedTable(d.spark, staging_path(d.spark, "documents"), ["track_id"])
    docs = freeze(documents(d).select("track_id", "title", "duration_ms", "explicit"), "upserted")
    table.upsert(docs.drop("explicit"), 0)
    edited = docs.withColumn("title", F.when(F.col("explicit"), F.concat("title", F.lit(" (edited)"))).otherwise(F.col("title")))
    table.change(edited.drop("explicit"), F.col("duration_ms") >= 400000, 1)
    return table.compact(staging_path(d.spark, "documents-compacted")).read()


@query(
    "document_failures",
    ctes("tracks") + """
    SELECT track_id, 'release_date' AS lacking FROM tracks WHERE release_date IS NULL OR year(release_date) > 1995""",
)
def document_failures(d):
    docs = documents(d).withColumn("release_date", F.when(F.col("release_date") < "1996", F.col("release_date")))
    _, failed = sinks.split_failures(docs, "track_id", ["title", "release_date"])
    return failed.select("track_id", F.concat_ws(",", "lacking").alias("lacking"))


@query(
    "topic_fanout",
    S + """
    SELECT topic, CAST(session_id AS VARCHAR) AS "key", event_type AS header, '{"event_id":' || event_id || '}' AS body
    FROM session_events, (VALUES ('events-topic'), ('history-topic')) t(topic)""",
)
def topic_fanout(d):
    messages = sinks.to_topics(
        d.session_events(), ["events-topic", "history-topic"], "session_id", F.col("event_type"), F.to_json(F.struct("event_id"))
    )
    return messages.select(
        "topic", F.col("key").cast("string"), F.col("headers")[0]["value"].cast("string").alias("header"),
        F.col("value").cast("string").alias("body"),
    )


@query("staged_snapshot", ctes("users") + "SELECT * FROM users")
def staged_snapshot(d):
    """Users written to the shared folder as Parquet and read back; no relational store is involved."""
    return freeze(d.users(), "users")
