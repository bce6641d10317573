"""Music-domain views over the given test tables.

Every view is a projection or join of whole tables, so the work of a query on it grows
with the tables. ``CTES`` states the same views in SQL for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.session import prepare, staging_path

#: Event kinds of the given ``events`` table and the session event each stands for.
#: Kinds with two entries alternate on the parity of ``k``.
SESSION_TYPES = {
    "signup": ("SessionStarted", "SessionStarted"),
    "view": ("ChunksAckEvent", "ChunksAckEvent"),
    "click": ("SessionPaused", "OffsetChangedEvent"),
    "purchase": ("SessionResumed", "BitrateChangedEvent"),
    "error": ("SessionStopped", "SessionStopped"),
}


# Streams read a table in so many shares of its order column, each of so many files.
STREAM_FILES = 4
SHARE_FILES = 4
CLOSING_DAYS = 400  # from the last row to the one that closes a stream
STREAM_ORDER = {"events": "ts", "lineitem": "l_shipdate", "customer": "c_custkey"}


class Domain:
    """The views, bound to one session and one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str, close: bool = False, delay: int = 0) -> DataFrame:
        """The same table as an unbounded source that brings a share a batch, in time order.

        With ``delay`` rows arrive up to that many seconds late, each by its own hash, so they
        come out of order. With ``close`` a last row of a far later time, all else null, moves
        every watermark past the table's rows, so that all that waits for it comes out.
        """
        rows, order, out = self.table(name), STREAM_ORDER[name], staging_path(self.spark, f"landed-{name}")
        arrival = F.col(order)
        if delay:
            arrival = F.unix_micros(F.col(order).cast("timestamp")) + F.pmod(F.xxhash64(*rows.columns), F.lit(delay * 1_000_000))
        given = rows.withColumn("_arrival", arrival)
        shares = [i / STREAM_FILES for i in range(1, STREAM_FILES)]
        borders = given.agg(F.percentile_approx("_arrival", shares)).first()[0] or [None] * len(shares)

        def land(part: DataFrame) -> None:
            # So many files are a share, and a trigger takes so many.
            part.repartition(SHARE_FILES).write.mode("append").parquet(out)

        for low, high in zip([None, *borders], [*borders, None], strict=True):
            inside = F.lit(True) if low is None else F.col("_arrival") > F.lit(low)
            upto = F.lit(True) if high is None else F.col("_arrival") <= F.lit(high)
            missing = F.col("_arrival").isNull() if low is None else F.lit(False)
            land(given.where((inside & upto) | missing).drop("_arrival"))
        if close:
            last = rows.agg(F.max(order).alias("_last"))
            ends = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields}
            ends[order] = (F.col("_last") + F.expr(f"INTERVAL {CLOSING_DAYS} DAYS")).cast(rows.schema[order].dataType)
            land(last.select(*[c.alias(n) for n, c in ends.items()]))
        return self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", SHARE_FILES).parquet(out)

    # -- playback events ---------------------------------------------------------------

    def session_events(self, events: DataFrame | None = None) -> DataFrame:
        """Sparse session events; user, track and bitrate only on start rows."""
        events = self.table("events") if events is None else events
        base = events.select(
            F.col("event_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.col("user_id"),
            _k().alias("k"),
            F.floor("value").cast("int").alias("amount"),
            _session_type().alias("event_type"),
        )

        def only(event_type: str, value: Column) -> Column:
            return F.when(F.col("event_type") == event_type, value)

        rate = F.element_at(F.array(F.lit(128), F.lit(192), F.lit(320)), F.col("k") % 3 + 1)
        return base.select(
            "event_id",
            "event_type",
            F.concat_ws("-", "user_id", F.date_format("timestamp", "yyyyMMdd")).alias("session_id"),
            only("SessionStarted", F.col("user_id")).alias("user_id"),
            only("SessionStarted", F.col("k").cast("long")).alias("track_id"),
            only("SessionStarted", rate).alias("bitrate"),
            only("BitrateChangedEvent", rate).alias("new_bitrate"),
            only("ChunksAckEvent", F.col("amount")).alias("acked_chunk_count"),
            only("SessionStopped", F.col("amount")).alias("total_chunks_sent"),
            only("OffsetChangedEvent", F.col("amount")).alias("new_chunk_offset"),
            only("OffsetChangedEvent", F.col("k")).alias("old_chunk_offset"),
            "timestamp",
        )

    def requests(self, events: DataFrame | None = None) -> DataFrame:
        """Request log: one row per gateway call."""
        events = self.table("events") if events is None else events
        k = _k()
        return events.select(
            F.col("event_id").alias("request_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(k % 2 == 0, "POST").otherwise("GET").alias("method"),
            F.col("event_type").alias("endpoint"),
            F.when(k < 5, 500).when(k < 15, 404).otherwise(200).alias("status"),
            (F.col("value") / 1000).alias("duration_s"),
        )

    def request_lines(self, events: DataFrame | None = None) -> DataFrame:
        """The request log as lines of JSON (``value``); a 404 has a path but no route.

        Every 97th request was cut off in the middle of its line, every 89th has no status.
        """
        rows = self.requests(events)
        found = F.col("status") != 404
        line = F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
                "method",
                F.when(found, F.concat(F.lit("/api/"), "endpoint")).alias("route"),
                F.concat(F.when(found, "/api/").otherwise("/raw/"), "endpoint").alias("path"),
                F.when(F.col("request_id") % 89 != 0, F.col("status")).alias("status"),
                "duration_s",
            )
        )
        half = F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))
        return rows.select(F.when(F.col("request_id") % 97 == 0, half).otherwise(line).alias("value"))

    def landed_requests(self) -> str:
        """Folder of log files that Spark has written from ``request_lines``."""
        out = staging_path(self.spark, "request-log")
        self.request_lines().repartition(STREAM_FILES * SHARE_FILES).write.text(out)
        return out

    # -- playlists ---------------------------------------------------------------------

    def playlist_tracks(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("playlist_id"),
            F.col("l_partkey").alias("track_id"),
            F.col("l_linenumber").alias("position"),
            F.col("l_shipdate").alias("added_at"),
        )

    def playlist_events(self, users: bool = True) -> DataFrame:
        """Adds to playlists; ``users=False`` leaves out the user and so the join."""
        adds = self.playlist_tracks().withColumnRenamed("added_at", "timestamp")
        if not users:
            return adds
        owners = self.table("orders").select(
            F.col("o_orderkey").alias("playlist_id"), F.col("o_custkey").alias("user_id")
        )
        return adds.join(owners, "playlist_id")

    def playlists(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("playlist_id"),
            F.concat(F.lit("Playlist "), "o_orderkey").alias("name"),
            (F.col("o_orderstatus") != "P").alias("is_public"),
            F.col("o_orderdate").alias("created_at"),
        )

    def playlist_users(self) -> DataFrame:
        """Owners (from orders) and subscribers (from line items, owner left out)."""
        owners = self.table("orders").select(
            F.col("o_orderkey").alias("playlist_id"),
            F.col("o_custkey").alias("user_id"),
            F.lit(True).alias("is_creator"),
        )
        links = self.table("lineitem").select(
            F.col("l_orderkey").alias("playlist_id"), F.col("l_suppkey").alias("user_id")
        ).distinct()
        return owners.unionByName(
            links.join(owners, ["playlist_id", "user_id"], "left_anti").withColumn("is_creator", F.lit(False))
        )

    # -- catalogue ---------------------------------------------------------------------

    def tracks(self, release: bool = True) -> DataFrame:
        tracks = self.table("part").select(
            F.col("p_partkey").alias("track_id"),
            F.col("p_name").alias("title"),
            (F.col("p_size") * 10000).alias("duration_ms"),
            (F.col("p_size") % 2 == 0).alias("explicit"),
        )
        if not release:
            return tracks
        released = self.table("lineitem").groupBy(F.col("l_partkey").alias("track_id")).agg(
            F.min("l_shipdate").cast("date").alias("release_date")
        )
        return tracks.join(released, "track_id", "left")

    def artists(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("artist_id"),
            F.col("s_name").alias("name"),
            (F.col("s_nationkey") < 12).alias("verified"),
        )

    def track_artists(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("artist_id")
        ).distinct()

    def _track_genre_names(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("track_id"),
            F.inline(
                F.array(
                    F.struct(F.ascii(F.substring("p_type", 2, 1)).alias("genre_id"), F.col("p_type").alias("name")),
                    F.struct(
                        (F.lit(200) + F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")).alias("genre_id"),
                        F.col("p_brand").alias("name"),
                    ),
                )
            ),
        )

    def genres(self) -> DataFrame:
        return self._track_genre_names().select("genre_id", "name").distinct()

    def track_genres(self) -> DataFrame:
        return self._track_genre_names().select("track_id", "genre_id")

    def track_bitrates(self) -> DataFrame:
        """Which bitrates each track is offered in, with the bitrate's name."""
        rate = F.element_at(F.array(F.lit(320), F.lit(128), F.lit(192)), F.col("l_linenumber") % 3 + 1)
        return self.table("lineitem").select(
            F.col("l_partkey").alias("track_id"), rate.alias("bitrate")
        ).distinct()

    def objects(self) -> DataFrame:
        """Listing of stored audio objects: path and size."""
        rate = F.element_at(F.array(F.lit(128), F.lit(192), F.lit(320)), (F.col("doc_id") % 3 + 1).cast("int"))
        return self.table("documents").select(
            F.concat(F.lit("tracks/"), "doc_id", F.lit("/"), rate, F.lit(".mp3")).alias("path"),
            F.col("n_chars").alias("length"),
        )

    # -- people ------------------------------------------------------------------------

    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lower("c_mktsegment"), "c_custkey").alias("username"),
            F.concat(
                F.lit("user"), "c_nationkey", F.lit("."), F.floor("c_acctbal").cast("string"),
                F.when(F.col("c_acctbal") < 1000, " at ").otherwise("@"), F.lit("example.com"),
            ).alias("email"),
            F.col("c_mktsegment").alias("role"),
            F.col("c_nationkey").alias("nation_id"),
        )

    def likes(self) -> DataFrame:
        return self._items_with_user(F.col("l_returnflag") == "R").select(
            "user_id", "track_id", F.col("ts").alias("liked_at")
        )

    def listens(self) -> DataFrame:
        return self._items_with_user().select(
            "user_id",
            "track_id",
            F.col("l_quantity").cast("long").alias("total_chunks_sent"),
            F.lit(50).cast("long").alias("total_chunks"),
            F.col("ts").alias("timestamp"),
        )

    def _items_with_user(self, where: Column | None = None) -> DataFrame:
        items = self.table("lineitem")
        if where is not None:
            items = items.where(where)
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "user_id", F.col("l_partkey").alias("track_id"), "l_quantity", F.col("l_shipdate").alias("ts")
        )

    def search_requests(self) -> DataFrame:
        """One search per customer: a misspelt track title, filters by market segment."""
        titles = self.table("part").select("p_partkey", "p_name")
        asked = self.table("customer").join(titles, F.col("c_custkey") == F.col("p_partkey"))
        first, second, rest = (F.substring("p_name", 1, 1), F.substring("p_name", 2, 1), F.expr("substr(p_name, 3)"))
        segment = F.col("c_mktsegment")
        return asked.select(
            F.col("c_custkey").alias("request_id"),
            F.when(segment == "MACHINERY", None)
            .when(segment == "BUILDING", F.concat(first, rest))
            .when(segment == "FURNITURE", F.concat(second, first, rest))
            .otherwise(F.col("p_name"))
            .alias("title"),
            F.when(segment == "FURNITURE", F.lit("suplier")).alias("artist_name"),
            F.when(segment == "AUTOMOBILE", F.array(F.lit("PROMO"), F.lit("Brand#7"))).alias("genres"),
            F.when(segment == "MACHINERY", (F.col("c_nationkey") * 10000)).alias("min_duration_ms"),
            F.when(segment.isin("MACHINERY", "BUILDING"), 300000).alias("max_duration_ms"),
            F.when(segment == "HOUSEHOLD", True).alias("explicit"),
            F.when(segment == "FURNITURE", F.lit("1995-01-05").cast("date")).alias("released_from"),
            F.lit(None).cast("date").alias("released_to"),
            F.when(segment == "HOUSEHOLD", 2).otherwise(1).alias("page"),
            F.lit(20).alias("page_size"),
        )

    # -- change data capture -----------------------------------------------------------

    def partial_cdc_lines(self) -> DataFrame:
        """``cdc_lines`` whose update images hold the key and the updated columns only."""
        value = F.col("value")
        after = F.from_json(F.get_json_object(value, "$.payload.after"), "event_id long, bitrate int, acked_chunk_count int")
        image = F.to_json(F.struct(F.struct(F.lit("u").alias("op"), after.alias("after")).alias("payload")))
        return self.cdc_lines().withColumn("value", F.when(F.get_json_object(value, "$.payload.op") == "u", image).otherwise(value))

    def cdc_lines(self, events: DataFrame | None = None) -> DataFrame:
        """Change envelopes of the session-event table, in log order (``offset``).

        Every row is inserted. Of the start rows, those with a track below 50 get an update
        (new bitrate and ack count) and those with a track of 90 or more a delete.
        """
        events = self.table("events") if events is None else events
        row = self.session_events(events).withColumn(
            "timestamp", F.unix_micros("timestamp")
        ).select(*CDC_ROW_FIELDS)
        k = F.coalesce("track_id", F.lit(-1))
        image = F.struct(*CDC_ROW_FIELDS)
        changed = F.struct(
            *[
                F.lit(320).alias(c) if c == "bitrate"
                else F.lit(1).alias(c) if c == "acked_chunk_count"
                else F.col(c)
                for c in CDC_ROW_FIELDS
            ]
        )
        nothing = F.lit(None).cast(row.select(image.alias("r")).schema["r"].dataType)

        def change(op: str, step: int, before: Column, after: Column) -> Column:
            return F.struct(
                F.lit(step).alias("step"), F.lit(op).alias("op"), before.alias("before"), after.alias("after")
            )

        steps = F.array(
            change("c", 0, nothing, image),
            F.when((k >= 0) & (k < 50), change("u", 1, image, changed)),
            F.when(k >= 90, change("d", 2, image, nothing)),
        )
        return row.select("event_id", F.explode(F.array_compact(steps)).alias("c")).select(
            F.to_json(
                F.struct(
                    F.lit("session_events").alias("schema"),
                    F.struct(
                        F.col("c.before").alias("before"), F.col("c.after").alias("after"), F.col("c.op").alias("op")
                    ).alias("payload"),
                ),
                {"ignoreNullFields": "false"},
            ).alias("value"),
            (F.col("event_id") * 4 + F.col("c.step")).alias("offset"),
        )


    def playlist_cdc_lines(self) -> DataFrame:
        """Insert envelopes of the playlist-event table, one per line item."""
        return _insert_lines(
            self.table("lineitem").select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
                F.lit("TrackAddedToPlaylist").alias("event_type"),
                F.col("l_orderkey").cast("int").alias("playlist_id"),
                F.col("l_partkey").cast("int").alias("track_id"),
                F.col("l_suppkey").cast("int").alias("user_id"),
                F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
            ),
            "playlist_events",
        )

    def user_cdc_lines(self) -> DataFrame:
        """Insert envelopes of the user-event table, one per order."""
        return _insert_lines(
            self.table("orders").select(
                F.col("o_orderkey").alias("event_id"),
                F.lit("UserRegistered").alias("event_type"),
                F.col("o_custkey").cast("string").alias("user_id"),
                F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
            ),
            "users_events",
        )


def _insert_lines(rows: DataFrame, table: str) -> DataFrame:
    payload = F.struct(F.struct(*rows.columns).alias("after"), F.lit("c").alias("op"))
    return rows.select(F.to_json(F.struct(F.lit(table).alias("schema"), payload.alias("payload"))).alias("value"))


CDC_ROW_FIELDS = [
    "event_id", "event_type", "session_id", "user_id", "track_id", "bitrate", "new_bitrate",
    "acked_chunk_count", "total_chunks_sent", "new_chunk_offset", "old_chunk_offset", "timestamp",
]


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _session_type() -> Column:
    even = _k() % 2 == 0
    chosen = None
    for kind, (on_even, on_odd) in SESSION_TYPES.items():
        name = F.lit(on_even) if on_even == on_odd else F.when(even, on_even).otherwise(on_odd)
        is_kind = F.col("event_type") == kind
        chosen = F.when(is_kind, name) if chosen is None else chosen.when(is_kind, name)
    return chosen


_CTE_SQL = {
    "session_events": """
        SELECT event_id, event_type, session_id,
               CASE WHEN event_type = 'SessionStarted' THEN user_id END AS user_id,
               CASE WHEN event_type = 'SessionStarted' THEN CAST(k AS BIGINT) END AS track_id,
               CASE WHEN event_type = 'SessionStarted' THEN rate END AS bitrate,
               CASE WHEN event_type = 'BitrateChangedEvent' THEN rate END AS new_bitrate,
               CASE WHEN event_type = 'ChunksAckEvent' THEN amount END AS acked_chunk_count,
               CASE WHEN event_type = 'SessionStopped' THEN amount END AS total_chunks_sent,
               CASE WHEN event_type = 'OffsetChangedEvent' THEN amount END AS new_chunk_offset,
               CASE WHEN event_type = 'OffsetChangedEvent' THEN k END AS old_chunk_offset,
               ts AS "timestamp"
        FROM (
            SELECT event_id, ts, user_id, k, CAST(floor(value) AS INTEGER) AS amount,
                   CAST(CASE k % 3 WHEN 0 THEN 128 WHEN 1 THEN 192 ELSE 320 END AS INTEGER) AS rate,
                   user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
                   CASE event_type
                       WHEN 'signup' THEN 'SessionStarted'
                       WHEN 'view' THEN 'ChunksAckEvent'
                       WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'SessionPaused' ELSE 'OffsetChangedEvent' END
                       WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'SessionResumed' ELSE 'BitrateChangedEvent' END
                       WHEN 'error' THEN 'SessionStopped'
                   END AS event_type
            FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        )""",
    "requests": """
        SELECT event_id AS request_id, ts,
               CASE WHEN k % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, event_type AS endpoint,
               CASE WHEN k < 5 THEN 500 WHEN k < 15 THEN 404 ELSE 200 END AS status,
               value / 1000 AS duration_s
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "playlist_tracks": """
        SELECT l_orderkey AS playlist_id, l_partkey AS track_id, l_linenumber AS position,
               l_shipdate AS added_at FROM lineitem""",
    "playlist_events": """
        SELECT l_orderkey AS playlist_id, l_partkey AS track_id, l_linenumber AS position,
               o_custkey AS user_id, l_shipdate AS "timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "playlists": """
        SELECT o_orderkey AS playlist_id, 'Playlist ' || o_orderkey AS name,
               o_orderstatus <> 'P' AS is_public, o_orderdate AS created_at FROM orders""",
    "playlist_users": """
        SELECT o_orderkey AS playlist_id, o_custkey AS user_id, TRUE AS is_creator FROM orders
        UNION ALL
        SELECT DISTINCT l_orderkey, l_suppkey, FALSE FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = l_suppkey)""",
    "tracks": """
        SELECT p_partkey AS track_id, p_name AS title, p_size * 10000 AS duration_ms,
               p_size % 2 = 0 AS explicit, release_date
        FROM part LEFT JOIN (SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS release_date
                             FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "artists": """
        SELECT s_suppkey AS artist_id, s_name AS name, s_nationkey < 12 AS verified FROM supplier""",
    "track_artists": "SELECT DISTINCT l_partkey AS track_id, l_suppkey AS artist_id FROM lineitem",
    "track_genre_names": """
        SELECT p_partkey AS track_id, ascii(substr(p_type, 2, 1)) AS genre_id, p_type AS name FROM part
        UNION ALL
        SELECT p_partkey, 200 + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER), p_brand FROM part""",
    "track_bitrates": """
        SELECT DISTINCT l_partkey AS track_id,
               CASE l_linenumber % 3 WHEN 0 THEN 320 WHEN 1 THEN 128 ELSE 192 END AS bitrate FROM lineitem""",
    "objects": """
        SELECT 'tracks/' || doc_id || '/' || CASE doc_id % 3 WHEN 0 THEN 128 WHEN 1 THEN 192 ELSE 320 END
               || '.mp3' AS path, n_chars AS length FROM documents""",
    "users": """
        SELECT c_custkey AS user_id, lower(c_mktsegment) || c_custkey AS username,
               'user' || c_nationkey || '.' || CAST(floor(c_acctbal) AS BIGINT)
               || CASE WHEN c_acctbal < 1000 THEN ' at ' ELSE '@' END || 'example.com' AS email,
               c_mktsegment AS role, c_nationkey AS nation_id FROM customer""",
    "likes": """
        SELECT o_custkey AS user_id, l_partkey AS track_id, l_shipdate AS liked_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "search_requests": """
        SELECT c_custkey AS request_id,
               CASE c_mktsegment WHEN 'MACHINERY' THEN NULL
                    WHEN 'BUILDING' THEN substr(p_name, 1, 1) || substr(p_name, 3)
                    WHEN 'FURNITURE' THEN substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3)
                    ELSE p_name END AS title,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN 'suplier' END AS artist_name,
               CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN ['PROMO', 'Brand#7'] END AS genres,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey * 10000 END AS min_duration_ms,
               CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 300000 END AS max_duration_ms,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN TRUE END AS explicit,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN DATE '1995-01-05' END AS released_from,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 2 ELSE 1 END AS page, 20 AS page_size
        FROM customer JOIN part ON p_partkey = c_custkey""",
    "listens": """
        SELECT o_custkey AS user_id, l_partkey AS track_id, CAST(l_quantity AS BIGINT) AS total_chunks_sent,
               CAST(50 AS BIGINT) AS total_chunks, l_shipdate AS "timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


def ctes(*names: str) -> str:
    """``WITH`` clause defining the named views for a comparison query."""
    return "WITH " + ", ".join(f"{n} AS ({_CTE_SQL[n].strip()})" for n in names)
