"""Session snapshots against a plain session object; change logs in every order of batches."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from listenlake.functions import scalars
from listenlake.operators import ordered, sessions
from listenlake.operators.changes import ChangeTable
from listenlake.sources import cdc
from test_streaming import SCHEMA, START


def _events(seed, count=500):
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        kind = draw.choice([*sessions.ALLOWED_BEFORE, "ChunksAckEvent", "BitrateChangedEvent", "OffsetChangedEvent", "unknown"])
        start = kind == "SessionStarted"
        rows.append(
            (i, kind, draw.choice(["hot", "hot", f"s{draw.randrange(12)}", None]), draw.randrange(5) if start else None,
             draw.randrange(4) if start else None, draw.choice([128, 192, 320]) if start else None,
             draw.choice([128, 192, 320, None]) if kind == "BitrateChangedEvent" else None,
             draw.randrange(9) if kind == "ChunksAckEvent" else None, None,
             draw.randrange(50) if kind == "OffsetChangedEvent" else None, None, START + dt.timedelta(minutes=i // 3))
        )
    return rows


TRACKS = [(0, [320, 128], 10, 1000), (1, [192], 20, 2000), (2, [], 30, 3000)]  # track 3 is unknown


def _plain(rows):
    """One session after another, event by event."""
    has, found = {t[0]: t[1] for t in TRACKS}, {}
    for r in sorted(rows, key=lambda r: (r[-1], r[0])):
        _, kind, session, user, track, rate, new, acked, _, offset, _, at = r
        s = found.setdefault(session, dict(status="NONE", chunk=0, paused=None, finished=None, refused=0))
        if s["status"] not in sessions.ALLOWED_BEFORE.get(kind, []):
            continue
        if kind == "SessionStarted":
            s |= dict(user=user, track=track, rate=rate, started=at)
        elif kind == "SessionPaused":
            s["paused"] = at
        elif kind == "SessionResumed":
            s["paused"] = None
        elif kind == "SessionStopped":
            s["finished"] = at
        elif kind == "ChunksAckEvent":
            s["chunk"] += acked
        elif kind == "OffsetChangedEvent":
            s["chunk"] = offset
        elif kind == "BitrateChangedEvent" and new in has.get(s["track"], []):
            s["rate"] = new
        elif kind == "BitrateChangedEvent":
            s["refused"] += 1
        s["status"] = sessions.STATE_AFTER.get(kind, s["status"])
    return {k: s for k, s in found.items() if s["status"] != "NONE"}


@pytest.mark.parametrize(("seed", "most"), [(1, 1 << 20), (2, 100), (3, 0)])
def test_snapshots_equal_a_session_object(spark, monkeypatch, seed, most):
    monkeypatch.setattr(ordered, "MOST_ROWS", most)
    rows = _events(seed)
    tracks = spark.createDataFrame(TRACKS, "track_id long, available_bitrates array<int>, total_chunks long, duration_ms long")
    found = sessions.snapshots(spark.createDataFrame(rows, SCHEMA).repartition(5), tracks)
    got = {
        r["session_id"]: dict(
            status=r["status"], chunk=r["current_chunk"], paused=r["paused_at"], finished=r["finished_at"],
            refused=r["refused_switches"], user=r["user_id"], track=r["track_id"], rate=r["current_bitrate"], started=r["started_at"],
        )
        for r in found.collect()
    }
    assert got == _plain(rows) and any(s["refused"] for s in got.values())
    text = found.select(scalars.snapshot_json(sessions.snapshot_struct(512)).alias("j")).collect()
    for body in map(json.loads, (r["j"] for r in text)):
        own = got[body.get("session_id")]
        assert ("paused_at" in body, "finished_at" in body) == (own["paused"] is not None, own["finished"] is not None)
        assert body["started_at"] == own["started"].isoformat(timespec="microseconds") and body["chunk_size"] == 512
        assert body["track"].get("total_chunks") == {t[0]: t[2] for t in TRACKS}.get(own["track"])


def test_refused_switches_are_flagged(spark):
    rows = [
        (0, "SessionStarted", "s", 1, 1, 128, *[None] * 5, START),
        (1, "BitrateChangedEvent", "s", None, None, None, 320, *[None] * 4, START),
        (2, "BitrateChangedEvent", "s", None, None, None, 192, *[None] * 4, START),
        (3, "SessionResumed", "s", *[None] * 8, START),
    ]
    tracks = spark.createDataFrame(TRACKS, "track_id long, available_bitrates array<int>, total_chunks long, duration_ms long")
    found = sessions.snapshot_timeline(spark.createDataFrame(rows, SCHEMA), tracks).orderBy("event_id").collect()
    assert [(r["applied"], r["current_bitrate"]) for r in found] == [(True, 128), (False, 128), (True, 192), (False, 192)]


def _line(op, at, before=None, after=None):
    return json.dumps({"payload": {"op": op, "before": before, "after": after}}), at


def test_state_is_the_same_for_every_order_of_batches(spark, tmp_path):
    batches = [
        [_line("c", 1, after={"event_id": 1, "event_type": "a", "session_id": "x", "bitrate": "1"}), _line("c", 2, after={"event_id": 2, "event_type": "b"}), ("garbage", 3)],
        [_line("u", 4, after={"event_id": 1, "bitrate": None}), _line("d", 5, before={"event_id": 2, "event_type": "b"}), _line("u", 9, after={"event_id": 3, "session_id": "late"})],
        [_line("c", 6, after={"event_id": 2, "bitrate": "7"}), _line("c", 8, after={"event_id": 3, "event_type": "c", "session_id": "first"}), _line("d", 7, before={"event_id": 1}), _line("d", 20, before={"event_id": 77})],
    ]
    expected = {(2, None, None, "7"), (3, "c", "late", None)}
    for n, order in enumerate(itertools.permutations(range(3))):
        table = ChangeTable(spark, str(tmp_path / str(n)), "event_id", cdc.columns(cdc.SESSION_ROW)[1:])
        for i in (*order, order[0]):  # the first is delivered again under its number
            lines = spark.createDataFrame(batches[i], "value string, offset long")
            table.write(cdc.partial_changes(lines, cdc.SESSION_ROW, "offset"), i)
        got = table.read().select("event_id", "event_type", "session_id", "bitrate").collect()
        assert set(map(tuple, got)) == expected
        assert table.read().where(F.col("timestamp").isNotNull()).isEmpty()
