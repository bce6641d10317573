"""Change envelopes, wire messages, listings, request logs and sinks on edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from listenlake import session
from listenlake.operators import changes, quality, sinks
from listenlake.sources import cdc, files, wire

ROW = {"event_id": 391771, "event_type": "TrackAddedToPlaylist", "playlist_id": 76, "track_id": 9308,
       "user_id": 741105, "timestamp": 1_748_000_000_123_456}


def _line(before, after, op):
    return json.dumps({"schema": None, "payload": {"before": before, "after": after, "op": op}})


@pytest.fixture(scope="module")
def lines(spark):
    moved = {**ROW, "playlist_id": 77}
    other = {**ROW, "event_id": 2}
    values = [
        (0, _line(None, ROW, "c")), (1, _line(None, other, "r")), (2, _line(ROW, moved, "u")), (3, _line(other, None, "d")),
        (4, None), (5, "garbage"), (6, "{}"),
    ]
    return spark.createDataFrame(values, "offset long, value string")


def test_parse_appends_inserts_and_updates(lines):
    rows = cdc.parse(lines, cdc.PLAYLIST_ROW).orderBy("event_id", "playlist_id").collect()
    assert [(r["event_id"], r["playlist_id"]) for r in rows] == [(2, 76), (391771, 76), (391771, 77)]
    assert rows[0]["timestamp"].microsecond == 123456


def test_current_state_and_audit(lines):
    log = cdc.changes(lines, cdc.PLAYLIST_ROW)
    state = changes.current_state(log, "event_id", "offset").collect()
    assert [(r["event_id"], r["playlist_id"]) for r in state] == [(391771, 77)]
    audit = changes.audit_log(log, "event_id", "offset", ["playlist_id", "track_id"]).collect()
    assert [tuple(r) for r in audit] == [(391771, 2, "playlist_id", "76", "77")]


def test_state_does_not_depend_on_the_split(lines):
    log = cdc.changes(lines, cdc.PLAYLIST_ROW)
    again = log.where("offset >= 2").unionByName(log.where("offset < 2")).repartition(3)
    assert changes.current_state(again, "event_id", "offset").collect() == changes.current_state(
        log, "event_id", "offset"
    ).collect()


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2"), ("", "3")], "user_id string, track_id string")
    rows = cdc.canonical_ids(df, ["user_id", "track_id"]).collect()
    assert [(r["user_id"], r["track_id"], r["problem"]) for r in rows] == [
        (1, None, "track_id"), (None, 2, None), (None, 3, "user_id"),
    ]


# -- wire ----------------------------------------------------------------------------------


def _typed(spark, rows):
    return spark.createDataFrame(
        rows,
        "event_type string, session_id string, user_id string, track_id string, bitrate string, new_bitrate int, "
        "acked_chunk_count int, total_chunks_sent int, total_chunks long, new_chunk_offset int, old_chunk_offset int, "
        "playlist_id int, micros long",
    ).withColumn("timestamp", F.timestamp_micros("micros")).drop("micros")


def test_every_message_type_round_trips(spark):
    at = 1_700_000_000_123_456
    rows = [
        ("SessionStarted", "s", "7", "9", "320", None, None, None, None, None, None, None, at),
        ("ChunksAckEvent", "s", None, None, None, None, 10, None, None, None, None, None, at),
        ("BitrateChangedEvent", "s", None, None, None, 128, None, None, None, None, None, None, at),
        ("OffsetChangedEvent", "s", None, None, None, None, None, None, None, 5, 0, None, at),
        ("SessionPaused", "s", None, None, None, None, None, None, None, None, None, None, at),
        ("SessionResumed", "s", None, None, None, None, None, None, None, None, None, None, at),
        ("SessionStopped", "s", None, None, None, None, None, 33, None, None, None, None, at),
        ("UserRegistered", None, "7", None, None, None, None, None, None, None, None, None, at),
        ("TrackAddedToPlaylist", None, "741105", "9308", None, None, None, None, None, None, None, 76, at),
        ("SessionHistory", None, "7", "9", None, None, None, 33, 66, None, None, None, at),
    ]
    typed = _typed(spark, rows)
    messages = wire.encode(typed).withColumn("timestamp", F.timestamp_micros(F.lit(0)))
    decoded = {r["event_type"]: r for r in wire.decode(messages).collect()}
    for row in typed.collect():
        got = decoded[row["event_type"]]
        assert got["problem"] is None
        for field in typed.columns:
            if row[field] is not None:
                assert str(got[field]) == str(row[field]), (row["event_type"], field)
    assert decoded["SessionPaused"]["user_id"] is None
    assert decoded["OffsetChangedEvent"]["old_chunk_offset"] == 0


def test_the_user_services_own_numbering(spark):
    # user_id = "7" in field 1, seconds = 5 in the time message of field 2.
    body = bytes([0x0A, 1, 0x37, 0x12, 2, 0x08, 5])
    df = spark.createDataFrame(
        [(None, body, [("event-type", b"UserRegistered")])],
        "key binary, value binary, headers array<struct<key: string, value: binary>>",
    ).withColumn("timestamp", F.timestamp_micros(F.lit(1_000_000)))
    as_consumer = wire.decode(df).select(F.unix_micros("timestamp"), "user_id").first()
    as_producer = wire.decode(df, wire.USER_SERVICE_MESSAGES).select(F.unix_micros("timestamp")).first()
    assert tuple(as_consumer) == (1_000_000, "7")  # its time is unknown there: the record's time
    assert as_producer[0] == 5_000_000


def test_unreadable_messages_are_named(spark):
    header = lambda name: [("event-type", name)]
    rows = [
        (b"", None), (b"", []), (b"", header(b"")), (b"", header(b"Unheard")),
        (b"\xff\xff\xff", header(b"SessionPaused")), (b"", header(b"SessionPaused")),
        (None, header(b"SessionPaused")),
    ]
    df = spark.createDataFrame(
        [(None, *r) for r in rows], "key binary, value binary, headers array<struct<key: string, value: binary>>"
    ).withColumn("timestamp", F.timestamp_micros(F.lit(0)))
    problems = [r["problem"] for r in wire.decode(df).collect()]
    assert problems == ["missing header"] * 3 + ["unknown type", "bad payload", None, "bad payload"]


# -- files ---------------------------------------------------------------------------------


def test_object_listing(spark, tmp_path):
    for track, name, size in [(1, "128.mp3", 10), (1, "320.mp3", 0), (2, "x.mp3", 5), (2, "192.txt", 5)]:
        folder = tmp_path / "tracks" / str(track)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"a" * size)
    listing = files.list_objects(spark, str(tmp_path))
    assert "content" not in listing.columns
    rows = {(r["track_id"], r["bitrate"], r["length"]) for r in files.object_rows(listing).collect()}
    assert rows == {(1, 128, 10), (2, None, 5)}  # file sources skip empty files
    tracks = spark.createDataFrame([(1,), (2,), (3,)], "track_id long")
    listing = files.list_track_objects(tracks, f"file://{tmp_path}/tracks")
    rows = {(r["track_id"], r["bitrate"], r["length"]) for r in files.object_rows(listing).collect()}
    assert rows == {(1, 128, 10), (1, 320, 0), (2, None, 5)}


def test_request_log(spark, tmp_path):
    entries = [
        {"ts": "2024-01-01T00:00:00Z", "method": "GET", "route": "/t/{id}", "path": "/t/1", "status": 200, "duration_s": 0.1},
        {"ts": "2024-01-01T00:00:01Z", "method": "GET", "path": "/nowhere", "status": 404, "duration_s": 0.2},
    ]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, entries)))
    rows = files.read_requests(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["endpoint"], r["status"]) for r in rows] == [("/t/{id}", 200), ("/nowhere", 404)]


def test_request_log_lines_with_problems(spark, tmp_path):
    whole = {"ts": "2024-01-01T00:00:00.123456Z", "method": "GET", "route": None, "path": "/p", "status": 200, "duration_s": 0.1}

    def without(*names):
        return json.dumps({k: v for k, v in whole.items() if k not in names})

    lines = {
        json.dumps(whole): None, json.dumps(whole | {"further": [1]}): None, without("path"): "no endpoint", without("ts", "status"): "no ts",
        without("status"): "no status", without("duration_s"): "no duration_s", json.dumps(whole)[:40]: "unreadable",
        json.dumps(whole | {"status": "ok"}): "unreadable", "not json": "unreadable",
    }
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n\n".join(lines) + "\n   \n")
    (tmp_path / "log" / "empty.json").write_text("")
    rows = files.read_request_log(spark, str(tmp_path / "log")).collect()
    assert {r["value"]: r["problem"] for r in rows} == lines and len(rows) == len(lines)
    good = files.read_requests(spark, str(tmp_path / "log"))
    assert good.columns == ["ts", "method", "status", "duration_s", "endpoint"]
    assert [r["ts"].microsecond for r in good.collect()] == [123456] * 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.json").write_text("")
    assert files.read_request_log(spark, str(tmp_path / "none")).count() == 0


# -- sinks ---------------------------------------------------------------------------------


def test_keyed_table_replay_version_and_deletes(spark, tmp_path):
    def rows(*values):
        return spark.createDataFrame(list(values), "k int, v string, at int")

    table = sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"])
    table.upsert(rows((1, "a", 5), (2, "b", 5)), 0)
    table.upsert(rows((1, "c", 3)), 10)
    table.upsert(rows((1, "c", 3)), 10)
    table.upsert(rows((1, "b", 4)), 9)
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(1, "c"), (2, "b")}
    by_time = sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"], "at")
    assert {(r["k"], r["v"]) for r in by_time.read().collect()} == {(1, "a"), (2, "b")}
    table.change(rows((2, None, 9)), F.lit(True), 11)
    compacted = table.compact(str(tmp_path / "t2"))
    assert {(r["k"], r["v"]) for r in compacted.read().collect()} == {(1, "c")}
    # A query with a fresh checkpoint counts its batches from 0 again; nothing compacted is lost.
    compacted.upsert(rows((3, "n", 1)), 0)
    assert {(r["k"], r["v"]) for r in compacted.read().collect()} == {(1, "c"), (3, "n")}
    compacted.upsert(rows((1, "d", 1)), 1)
    assert {(r["k"], r["v"]) for r in compacted.read().collect()} == {(1, "d"), (3, "n")}
    with pytest.raises(ValueError):
        compacted.upsert(rows((9, "x", 1)), 0, sinks.BASE)


def test_compaction_keeps_deletions_and_their_version(spark, tmp_path):
    def rows(*values):
        return spark.createDataFrame(list(values), "k int, v string, at int")

    table = sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"], "at", "k int, v string, at int")
    assert table.read().isEmpty()
    table.upsert(rows((1, "a", 5), (2, "b", 5)), 0)
    table.change(rows((1, None, 8)), F.lit(True), 0, "deletions")
    compacted = table.compact(str(tmp_path / "t2"))
    compacted.upsert(rows((1, "older", 7)), 0)
    assert {(r["k"], r["v"]) for r in compacted.read().collect()} == {(2, "b")}
    compacted.upsert(rows((1, "equal", 8)), 1)
    assert {(r["k"], r["v"]) for r in compacted.read().collect()} == {(2, "b")}
    compacted.upsert(rows((1, "newer", 9)), 2)
    assert {(r["k"], r["v"]) for r in compacted.read().collect()} == {(1, "newer"), (2, "b")}


def test_shared_folder_is_required_off_local_masters():
    made = []
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session._local_dir(master, made.append, lambda: made[-1])
    assert not made and session._local_dir("local[4]", made.append, lambda: made[-1]) == made[0]


def test_failed_documents_are_reported(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "track_id int, title string")
    good, failed = sinks.split_failures(docs, "track_id", ["title"])
    assert [r["track_id"] for r in good.collect()] == [1]
    assert sorted(r["lacking"][0] for r in failed.collect()) == ["title", "track_id"]


def test_quarantine_splits_everything(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (2, "bad"), (3, None)], "id int, email string")
    good, bad = quality.quarantine(df, {"email": F.col("email").contains("@")})
    assert [r["id"] for r in good.collect()] == [1]
    assert sorted((r["id"], r["reasons"]) for r in bad.collect()) == [(2, ["email"]), (3, ["email"])]


def test_sorted_layout(spark, tmp_path):
    df = spark.range(1000).select(
        (F.col("id") % 7).cast("string").alias("session_id"), F.timestamp_seconds(F.col("id") * 600).alias("timestamp")
    )
    sinks.write_events(df, str(tmp_path / "e"), sinks.SORT_KEYS["session_events"])
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.count() == 1000 and "event_date" in back.columns
    one_file = back.withColumn("f", F.input_file_name())
    first = one_file.where(F.col("f") == one_file.first()["f"]).drop("f").collect()
    keys = [(r["event_date"], r["session_id"], r["timestamp"]) for r in first]
    assert keys == sorted(keys)


def test_topic_copies(spark):
    df = spark.createDataFrame([("s", "SessionPaused")], "session_id string, event_type string")
    rows = sinks.to_topics(df, ["a", "b"], "session_id", F.col("event_type"), F.lit("x")).collect()
    assert sorted(r["topic"] for r in rows) == ["a", "b"]
    assert rows[0]["headers"][0]["key"] == "event-type" and bytes(rows[0]["key"]) == b"s"
