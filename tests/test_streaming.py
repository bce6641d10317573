"""Streams over several batches equal their batch twins; replays change nothing."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from listenlake.operators import charts, history, sessions
from listenlake.operators.sinks import KeyedTable
from listenlake.plans import live as plans_live
from listenlake.sources import cdc
from listenlake.sources.domain import Domain
from listenlake.streaming import live, pipelines

SCHEMA = (
    "event_id long, event_type string, session_id string, user_id long, track_id long, bitrate int, new_bitrate int, "
    "acked_chunk_count int, total_chunks_sent int, new_chunk_offset int, old_chunk_offset int, timestamp timestamp"
)
START = dt.datetime(2024, 1, 1)


def _events(count=120):
    rng = random.Random(2)
    rows = []
    for i in range(count):
        kind = rng.choice(list(sessions.ALLOWED_BEFORE))
        rows.append(
            (i, kind, f"s{rng.randint(0, 8)}", rng.randint(0, 5), 1, 128, 192, rng.randint(1, 9), rng.randint(1, 9), 5, 2,
             START + dt.timedelta(minutes=13 * i, microseconds=i))
        )
    return rows


@pytest.fixture
def topic(spark, tmp_path):
    """A folder receiving the events as four files, in time order."""
    folder = str(tmp_path / "topic")
    rows = _events()
    for i in range(0, len(rows), 30):
        spark.createDataFrame(rows[i : i + 30], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_live_metrics_equal_batch(spark, topic, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["period"])
    query = pipelines.each_batch(
        live.daily_chunks(_stream(spark, topic), "2 days"), live.upsert_into(table), str(tmp_path / "c"), "update", once=True
    )
    query.awaitTermination()
    batch = charts.chunks_per_day(spark.createDataFrame(_events(), SCHEMA)).select(
        F.col("day").alias("period"), "sent_chunks", "acked_chunks"
    )
    assert _rows(table.read()) == _rows(batch)


def test_deduplication_over_batches(spark, tmp_path):
    folder = str(tmp_path / "topic")
    rows = _events(40)
    for part in (rows[:20], rows[10:30], rows[20:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    once = live.deduplicate(_stream(spark, folder).select("event_id", "timestamp"), "event_id", "timestamp", "2 days")
    pipelines.append_files(once, str(tmp_path / "o"), str(tmp_path / "c"), once=True).awaitTermination()
    ids = [r["event_id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert sorted(ids) == list(range(40))


def test_late_rows_are_counted_not_written(spark, tmp_path):
    folder = str(tmp_path / "topic")
    rows = _events(60)
    late = rows[:5]
    for part in (rows[20:], rows[59:], late):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    ended = live.expired_sessions(_stream(spark, folder), "session_id", "timestamp", "10 minutes", 600)
    counted = pipelines.LateRows()
    spark.streams.addListener(counted)
    query = pipelines.append_files(ended, str(tmp_path / "o"), str(tmp_path / "c"), once=True)
    query.awaitTermination()
    deadline = time.time() + 30  # reports arrive beside the query
    while counted.of(query) < len(late) and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(counted)
    assert counted.of(query) == len(late)
    first = spark.read.parquet(str(tmp_path / "o")).agg(F.min("first_at")).first()[0]
    assert first >= rows[20][-1]


def test_restart_and_failed_batch_write_each_row_once(spark, topic, tmp_path):
    out, checkpoint = str(tmp_path / "o"), str(tmp_path / "c")
    write = pipelines.batch_folder(out)
    calls = []

    def failing(batch, batch_id):
        calls.append(batch_id)
        write(batch, batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("killed after the write")

    with pytest.raises(Exception):
        pipelines.each_batch(_stream(spark, topic), failing, checkpoint, once=True).awaitTermination()
    pipelines.each_batch(_stream(spark, topic), failing, checkpoint, once=True).awaitTermination()
    assert calls.count(1) == 2
    ids = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert ids == list(range(120))
    pipelines.each_batch(_stream(spark, topic), failing, checkpoint, once=True).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ids


def test_enrichment_over_batches(spark, topic, tmp_path):
    starts = KeyedTable(spark, str(tmp_path / "s"), ["session_id"], "first")
    write = live.capture_sessions(starts, str(tmp_path / "e"))
    pipelines.each_batch(_stream(spark, topic), write, str(tmp_path / "c"), once=True).awaitTermination()
    names = ["event_id", "session_id", "user_id", "track_id", "start_bitrate"]
    events = spark.createDataFrame(_events(), SCHEMA)

    def got():
        return live.enriched(spark.read.parquet(str(tmp_path / "e")), starts)

    assert _rows(got().select(*names)) == _rows(sessions.enrich(events).select(*names))
    # A start earlier than all others arrives last, by a replayed batch of another number.
    early = spark.createDataFrame([(999, "SessionStarted", "s0", 77, 1, 64, *[None] * 5, START - dt.timedelta(days=1))], SCHEMA)
    write(early, 50)
    write(early, 50)
    both = events.union(early)
    assert _rows(got().select(*names)) == _rows(sessions.enrich(both).select(*names))


def test_history_and_deletions(spark, tmp_path):
    schema = "user_id long, track_id long, total_chunks_sent long, total_chunks long, timestamp timestamp"
    day = lambda n: START + dt.timedelta(days=n)
    parts = [
        [(1, 1, 50, 100, day(5)), (1, 2, 49, 100, day(5)), (2, 1, 100, 100, day(1)), (3, 3, 0, 0, day(1))],
        [(1, 1, 90, 100, day(3)), (2, 1, 60, 100, day(2)), (2, 9, 60, 100, day(9))],
    ]
    folder = str(tmp_path / "topic")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    listens = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    table = KeyedTable(spark, str(tmp_path / "h"), ["user_id", "track_id"], "timestamp")
    pipelines.each_batch(listens, live.upsert_history(table), str(tmp_path / "c"), once=True).awaitTermination()
    batch = history.latest(spark.createDataFrame(parts[0] + parts[1], schema))
    assert _rows(table.read()) == _rows(batch)
    gone = str(tmp_path / "gone")
    spark.createDataFrame([(2, day(5))], "user_id long, timestamp timestamp").write.parquet(gone)
    deletions = spark.readStream.schema("user_id long, timestamp timestamp").parquet(gone)
    deleted = KeyedTable(spark, str(tmp_path / "x"), ["user_id"], "timestamp", "user_id long, timestamp timestamp")

    def left():
        return {(r["user_id"], r["track_id"]) for r in live.without_deleted(table.read(), deleted).collect()}

    assert left() == {(1, 1), (3, 3), (2, 1), (2, 9)}  # no deletion has been written yet
    pipelines.each_batch(deletions, live.record_deletions(deleted), str(tmp_path / "d"), once=True).awaitTermination()
    assert left() == {(1, 1), (3, 3), (2, 9)}
    # The same deletion batch written again, as after a crash before its commit.
    live.record_deletions(deleted)(spark.read.parquet(gone), 0)
    # A listen older than the deletion, arriving after it.
    table.upsert(spark.createDataFrame([(2, 4, day(3))], "user_id long, track_id long, timestamp timestamp"), 0, "late")
    assert left() == {(1, 1), (3, 3), (2, 9)}


def test_three_capture_pipelines_with_their_own_checkpoints(spark, tmp_path):
    bodies = {
        "session_events": {"event_id": 1, "event_type": "SessionPaused", "session_id": "s", "timestamp": 5},
        "playlist_events": {"event_id": 2, "event_type": "TrackAddedToPlaylist", "playlist_id": 3, "timestamp": 5},
        "users_events": {"event_id": 4, "event_type": "UserRegistered", "user_id": "u", "timestamp": 5},
    }
    sources = {}
    for name, after in bodies.items():
        folder = tmp_path / "topics" / name
        folder.mkdir(parents=True)
        lines = [json.dumps({"payload": {"after": after, "op": "c"}}), "garbage", json.dumps({"payload": {"op": "d"}})]
        (folder / "0.json").write_text("\n".join(lines))
        sources[name] = cdc.read_lines(spark, str(folder), 1)

    def run():
        queries = pipelines.run_cdc(sources, str(tmp_path / "out"), str(tmp_path / "checkpoints"), once=True)
        for query in queries.values():
            query.awaitTermination()
        return {n: [r["event_id"] for r in spark.read.parquet(str(tmp_path / "out" / n)).collect()] for n in queries}

    assert run() == {"session_events": [1], "playlist_events": [2], "users_events": [4]}
    assert sorted(p.name for p in (tmp_path / "checkpoints").iterdir()) == sorted(bodies)
    more = {"payload": {"after": {**bodies["users_events"], "event_id": 9}, "op": "c"}}
    (tmp_path / "topics" / "users_events" / "1.json").write_text(json.dumps(more))
    assert {n: sorted(ids) for n, ids in run().items()} == {
        "session_events": [1], "playlist_events": [2], "users_events": [4, 9]
    }


def test_three_captured_tables_with_defaults(spark, tmp_path):
    bodies = {
        "session_events": {"event_id": 1, "event_type": "SessionPaused", "session_id": "s", "timestamp": 1_500_000},
        "playlist_events": {"event_id": 2, "event_type": "TrackAddedToPlaylist", "playlist_id": 3, "timestamp": None},
        "users_events": {"event_id": 4, "event_type": None, "user_id": None, "timestamp": 5},
    }
    sources = {}
    for name, after in bodies.items():
        folder = tmp_path / "topics" / name
        folder.mkdir(parents=True)
        lines = [json.dumps({"payload": {"after": after, "op": "c"}}), "garbage"]
        (folder / "0.json").write_text("\n".join(lines))
        sources[name] = cdc.read_lines(spark, str(folder), 1)
    for query in pipelines.run_capture(spark, sources, str(tmp_path / "out"), str(tmp_path / "c"), 1, once=True).values():
        query.awaitTermination()
    stored = {n: t.read().first().asDict() for n, t in pipelines.capture_tables(spark, str(tmp_path / "out")).items()}
    session, playlist, user = (stored[n] for n in bodies)
    assert (session["user_id"], session["bitrate"], session["new_bitrate"]) == ("", "", 0)
    assert session["timestamp"].microsecond == 0 and session["event_date"].isoformat() == "1970-01-01"
    assert (playlist["track_id"], playlist["user_id"], playlist["timestamp"], playlist["event_date"]) == (0, 0, None, None)
    assert (user["event_type"], user["user_id"]) == ("", "")


def test_landed_lines_are_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """A larger table gives more files, not larger ones, and the batches keep their number."""
    monkeypatch.setattr(plans_live, "LINES_A_FILE", 10)
    spark.range(95).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    d = Domain(spark, str(tmp_path))
    lines = d.table("events").select(F.col("event_id").cast("string").alias("value"))
    a_batch = plans_live._land(d, lines, str(tmp_path / "topic"), "events")
    written = spark.read.text(str(tmp_path / "topic")).groupBy(F.input_file_name()).count().collect()
    assert (len(written), a_batch) == (10, 3) and max(r["count"] for r in written) <= 10 + 2
    assert sum(r["count"] for r in written) == 95


def test_landed_rows_keep_their_offsets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans_live, "LINES_A_FILE", 5)
    rows = spark.range(20).select(F.col("id").alias("event_id"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    lines = rows.select(F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("offset"))
    assert plans_live._land(Domain(spark, str(tmp_path)), lines, str(tmp_path / "topic"), "events", "parquet") == 1
    assert sorted(r["offset"] for r in spark.read.parquet(str(tmp_path / "topic")).where("value = offset").collect()) == list(range(20))
