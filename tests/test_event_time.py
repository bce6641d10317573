"""Streams in event time: rows out of order, late rows, closing rows, replays, switches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from listenlake.operators import sessions
from listenlake.streaming import live, pipelines
from listenlake.streaming.capture import CaptureTable
from listenlake.streaming.cascade import Cascade
from listenlake.streaming.late import LateSplit
from listenlake.streaming.session_machine import EXPIRED, live_states
from test_streaming import SCHEMA, START, _events, _rows, _stream

LAST = (None, None, "closing", *[None] * 8, START + dt.timedelta(days=300))


def _land(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, rows, tmp_path, name="o"):
    query = pipelines.append_files(rows, str(tmp_path / name), str(tmp_path / f"{name}-c"), once=True)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(str(tmp_path / name)), query


def _walk(rows, idle, strict):
    """What happens to each session, row by row in order of time."""
    out, by_session = [], {}
    for r in rows:
        by_session.setdefault(r[2], []).append((r[-1], r[0], r[1]))
    for session, own in by_session.items():
        status, last = "NONE", None
        for at, event_id, kind in [*sorted(own), (dt.datetime.max, None, None)]:
            if last is not None and (kind is None or at - last >= idle):
                if status not in ("NONE", "STOPPED"):
                    out.append((session, None, EXPIRED, last, status, "STOPPED", True))
                status = "NONE"
            if kind is None:
                break
            legal = status in sessions.ALLOWED_BEFORE[kind]
            after = sessions.STATE_AFTER.get(kind, status) if legal or not strict else status
            out.append((session, event_id, kind, at, status, after, legal))
            status, last = after, at
    return sorted(map(str, out))


@pytest.mark.parametrize(("strict", "seed"), [(False, 1), (False, 2), (True, 3)])
def test_states_do_not_depend_on_the_batches(spark, tmp_path, strict, seed):
    rows = _events(150)
    dealt = rows[:]
    random.Random(seed).shuffle(dealt)
    # Rows out of order across batches, but never behind the watermark: it is 40 days back.
    _land(spark, str(tmp_path / "t"), [dealt[:60], dealt[60:70], dealt[70:], [LAST]])
    out, _ = _run(spark, live_states(_stream(spark, str(tmp_path / "t")), "40 days", 3 * 3600, strict), tmp_path)
    assert sorted(map(str, map(tuple, out.collect()))) == _walk(rows, dt.timedelta(hours=3), strict)
    assert out.where(F.col("event_type") == EXPIRED).count() > 3


def test_rows_wait_for_the_watermark_and_sessions_expire_once(spark, tmp_path):
    day = lambda n: START + dt.timedelta(days=n)
    event = lambda i, kind, s, at: (i, kind, s, *[None] * 8, at)
    folder = str(tmp_path / "t")
    _land(spark, folder, [[event(1, "SessionPaused", "a", day(1))], [event(0, "SessionStarted", "a", day(0.9)), event(2, "SessionStarted", "b", day(3))]])
    out, _ = _run(spark, live_states(_stream(spark, folder), "1 day", 6 * 3600), tmp_path)
    seen = [(r["event_id"], r["event_type"], r["state_after"]) for r in out.orderBy("timestamp", "event_type").collect()]
    # Session a is past the watermark, with its start first; b, newer than that, still waits.
    assert seen == [(0, "SessionStarted", "STARTED"), (None, EXPIRED, "STOPPED"), (1, "SessionPaused", "PAUSED")]


def test_many_sessions_share_few_state_rows(spark, tmp_path):
    rows = [(i, "SessionStarted", f"s{i % 60}" if i % 7 else None, *[None] * 8, START + dt.timedelta(minutes=i)) for i in range(300)]
    _land(spark, str(tmp_path / "t"), [rows[:200], rows[200:], [LAST]])
    out, query = _run(spark, live_states(_stream(spark, str(tmp_path / "t")), "40 days", 3600, buckets=3), tmp_path)
    assert sorted(map(str, map(tuple, out.collect()))) == _walk(rows, dt.timedelta(hours=1), False)
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert 0 < max(held) <= 3


def test_live_enrichment(spark, tmp_path):
    hour = lambda n: START + dt.timedelta(hours=n)
    start = lambda i, s, at, user: (i, "SessionStarted", s, user, 7, 128, *[None] * 5, at)
    ack = lambda i, s, at: (i, "ChunksAckEvent", s, *[None] * 8, at)
    folder = str(tmp_path / "t")
    parts = [
        [ack(10, "a", hour(2)), ack(11, "a", hour(30)), ack(12, "none", hour(3))],
        [start(1, "a", hour(1), 5), start(2, "a", hour(1.5), 6), start(3, "late", hour(20), 8), ack(13, "late", hour(21))],
        [ack(20 + i, "many", hour(40 + i)) for i in range(100)],
        [LAST],
    ]
    _land(spark, folder, parts)
    rows, query = _run(spark, live.enriched_live(_stream(spark, folder), "1 day", "6 HOURS"), tmp_path)
    best = {r["event_id"]: r["user_id"] for r in live.latest_start(rows).collect()}
    # 10 has two starts, the later counts; 11 is out of reach of both; 12 has none.
    assert (best[10], best[11], best[12], best[13], best[1], best[2]) == (6, None, None, 8, 5, 6)
    assert len(best) == 107 and rows.where("event_id = 10").count() == 2
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) > 100 and held[-1] <= 2  # all but the closing row have left the state


def test_late_rows_are_kept_and_corrected(spark, tmp_path):
    split = LateSplit(spark, str(tmp_path / "s"), "ts", 86_400)
    day = lambda n: START + dt.timedelta(days=n)
    parts = [
        [(1, day(0)), (2, day(5)), (3, day(5))],
        [(4, day(4.5)), (5, day(1)), (6, None), (7, day(0))],
        [(8, day(9)), (9, day(2))],
        [(10, day(5)), (11, day(8.5))],
    ]
    frames = [spark.createDataFrame(p, "id int, ts timestamp") for p in parts]
    for n, df in enumerate(frames):
        split.write(df, n)
        if n:
            split.write(frames[n - 1], n - 1)  # an earlier batch replayed after a crash
            split.write(df, n)
    assert sorted((r["id"], r["batch_id"]) for r in split.late_rows().collect()) == [(5, 1), (6, 1), (7, 1), (9, 2), (10, 3)]
    count = lambda df: {r["period"]: r["n"] for r in df.collect()}
    whole = {}
    for part in parts:
        for _, ts in part:
            if ts is not None:
                whole[ts.date()] = whole.get(ts.date(), 0) + 1
    assert count(split.corrected_days()) == count(split.live_days()) != whole
    split.correct(1)
    assert sum(count(split.corrected_days()).values()) == 6 + 2
    split.correct(3)
    split.correct(3)
    assert count(split.corrected_days()) == whole


def test_captured_days_are_merged_by_a_switch(spark, tmp_path):
    rows = [tuple(v if i != 5 else None if v is None else str(v) for i, v in enumerate(r)) for r in _events(400)]
    schema = SCHEMA.replace("bitrate int, new", "bitrate string, new")
    draw = random.Random(4)
    parts = [[] for _ in range(4)]
    for r in rows:
        parts[min(3, int((r[-1] - START).days) + draw.randrange(2))].append(r)
    frames = [spark.createDataFrame(p, schema) for p in parts]
    table = CaptureTable(spark, str(tmp_path / "t"), ["session_id", "timestamp"])
    expected = []
    for n, df in enumerate(frames):
        table.write(df, n)
        table.write(df, n)
        expected += parts[n]
        assert sorted(r["event_id"] for r in table.read().collect()) == sorted(r[0] for r in expected)
        if n == 1:
            table.merge(1)
            before = _rows(table.read())
            # A merge that wrote its rows and died before its manifest changes nothing.
            table.read().limit(5).write.partitionBy("event_date").parquet(str(tmp_path / "t" / "merged" / "version=9"))
            assert _rows(table.read()) == before
            table.merge(1)  # repeated
            assert _rows(table.read()) == before
    unmerged = _rows(table.read())
    table.merge(3)
    assert _rows(table.read()) == unmerged and len(unmerged) == 400
    assert table.read().where("bitrate is null or user_id is null or track_id is null").isEmpty()
    one = table.read().where("event_date = DATE '2024-01-02' and session_id = 's3'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(session_id,s3)" in plan
    untouched = table._manifest(3).where("version = 1").count()
    assert 0 < untouched < table._manifest(3).count()  # days without new rows stay where they are


def test_captured_rows_without_a_time_stay(spark, tmp_path):
    schema = "event_id long, user_id string, timestamp timestamp"
    table = CaptureTable(spark, str(tmp_path / "t"), ["user_id", "timestamp"])
    write = table.writer(merge_every=2)
    for n in range(5):
        write(spark.createDataFrame([(2 * n, None, None), (2 * n + 1, "u", START)], schema), n)
        write(spark.createDataFrame([(2 * n, None, None), (2 * n + 1, "u", START)], schema), n)  # replayed, also after a merge
        rows = {r["event_id"]: (r["user_id"], r["timestamp"] is None, r["event_date"] is None) for r in table.read().collect()}
        assert rows == {i: ("u", False, False) if i % 2 else ("", True, True) for i in range(2 * n + 2)}
        assert table.read().count() == len(rows)
    assert table._state() == (3, 3) and table._manifest(3).count() == 2


def test_cascade_over_batches(spark, tmp_path):
    users = lambda *ids: spark.createDataFrame([(i,) for i in ids], "user_id long")
    likes = spark.createDataFrame([(u, t) for u in range(6) for t in range(3)], "user_id long, track_id long")
    owners = spark.createDataFrame([(10 * u + p, u) for u in range(6) for p in range(2)], "playlist_id long, user_id long")
    links = owners.union(spark.createDataFrame([(0, 3), (11, 0), (30, 1), (None, 2)], "playlist_id long, user_id long"))
    tracks = owners.select("playlist_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("track_id"))
    tables = {"likes": lambda: likes, "links": lambda: links, "tracks": lambda: tracks}
    cascade = Cascade(spark, str(tmp_path / "c"), tables, lambda: owners)
    assert cascade.left(likes).count() == 18
    for n, batch in enumerate([users(0, 0), users(0, 3, None), users(77)]):
        cascade.write(batch, n)
        cascade.write(batch, n)
    counts = {(r["batch_id"], r["table"]): r["affected"] for r in cascade.affected().collect()}
    # User 0: three likes; own links, one of user 3 to playlist 0, one to 11; two playlists of two tracks.
    assert counts == {
        (0, "likes"): 3, (0, "links"): 4, (0, "tracks"): 4,
        (1, "likes"): 3, (1, "links"): 3, (1, "tracks"): 4,
        (2, "likes"): 0, (2, "links"): 0, (2, "tracks"): 0,
    }
    assert {r["user_id"] for r in cascade.left(likes).collect()} == {1, 2, 4, 5}
    assert cascade.left(links).count() == 16 - 7 and cascade.left(tracks).count() == 16
    late = spark.createDataFrame([(3, 9), (4, 9)], "user_id long, track_id long")
    assert [r["user_id"] for r in cascade.left(late).collect()] == [4]
