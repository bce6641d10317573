"""Live session states with expiry, in order of event time, as custom state per session."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from listenlake.operators.sessions import ALLOWED_BEFORE, IDLE_SECONDS, STATE_AFTER

OUTPUT = (
    "session_id string, event_id bigint, event_type string, timestamp timestamp, "
    "state_before string, state_after string, legal boolean"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
STATE = (
    "sessions array<string>, statuses array<string>, lasts array<bigint>, "
    "times array<bigint>, ids array<bigint>, owners array<string>, types array<string>"
)
EXPIRED = "SessionExpired"
ENDED = ("STOPPED", "NONE")
# Sessions are kept by hash in so many state rows: few calls of Python, each a small share of all rows.
BUCKETS = 1024


class Sessions:
    """A bucket of sessions between batches: status and last applied time of each, and rows that wait."""

    def __init__(self, kept: tuple | None, idle: int, strict: bool):
        sessions, statuses, lasts, *waiting = [list(c or []) for c in kept or [[]] * 7]
        self.known = dict(zip(sessions, zip(statuses, lasts, strict=True), strict=True))
        self.waiting = list(zip(*waiting, strict=True))
        self.idle, self.strict = idle, strict
        self.out: list[tuple] = []

    def take(self, rows: pd.DataFrame) -> None:
        text = [[x if isinstance(x, str) else None for x in rows[c]] for c in ("session_id", "event_type")]
        self.waiting += zip(rows["at"].tolist(), rows["event_id"].tolist(), *text, strict=True)

    def _expire(self, session: str | None, status: str, last: int) -> None:
        if status not in ENDED:
            self.out.append((session, None, EXPIRED, last, status, "STOPPED", True))

    def advance(self, watermark: int) -> None:
        """Apply all rows up to the watermark in order of (time, id); no earlier ones can come."""
        ready = sorted((r for r in self.waiting if r[0] <= watermark), key=itemgetter(0, 1))
        self.waiting = [r for r in self.waiting if not r[0] <= watermark]
        for at, event_id, session, event in ready:
            before, last = self.known.get(session, ("NONE", None))
            if last is not None and at - last >= self.idle:
                self._expire(session, before, last)
                before = "NONE"
            legal = before in ALLOWED_BEFORE.get(event, [])
            after = STATE_AFTER.get(event, before) if legal or not self.strict else before
            self.known[session] = (after, at)
            self.out.append((session, event_id, event, at, before, after, legal))
        silent = [(s, *k) for s, k in self.known.items() if k[1] + self.idle <= watermark]
        for session, status, last in silent:
            self._expire(session, status, last)
            del self.known[session]

    def due(self) -> int | None:
        """When the watermark next changes something; None if nothing is left."""
        ends = (last + self.idle for _, last in self.known.values())
        return min(chain((r[0] for r in self.waiting), ends), default=None)

    def kept(self) -> tuple:
        """The bucket as its state row."""
        known = [(s, *k) for s, k in self.known.items()]
        return (*_columns(known, 3), *_columns(self.waiting, 4))


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(width)]


def live_states(
    events: DataFrame, lateness: str, idle_seconds: int = IDLE_SECONDS, strict: bool = False, buckets: int = BUCKETS
) -> DataFrame:
    """State around each event in order of event time, and expiry of silent sessions.

    A row waits in its session's state until the watermark has passed it, so its state does not
    depend on the batch that brought it. After ``idle_seconds`` without an event a session that
    is neither stopped nor unbegun gives one ``SessionExpired`` row at its last event's time, and
    what follows begins anew. With ``strict`` illegal events leave the state.

    The state holds rows of the last ``lateness`` only, and those of sessions not yet silent for
    ``idle_seconds``. Sessions share ``buckets`` state rows by hash, a number that must stay the same
    as long as the checkpoint lives. Rows of one (timestamp, event_id) are applied as they come; rows
    without a session form one of their own.
    """
    idle = idle_seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions = Sessions(state.get if state.exists else None, idle, strict)
        for rows in batches:
            sessions.take(rows)
        watermark = state.getCurrentWatermarkMs()
        sessions.advance(watermark * 1000)
        due = sessions.due()
        if due is None:
            state.remove()
        else:
            state.update(sessions.kept())
            # A timer fires once the watermark is past it, so it is set one before.
            state.setTimeoutTimestamp(max(-(-due // 1000) - 1, watermark + 1))
        if sessions.out:
            found = pd.DataFrame(sessions.out, columns=COLUMNS)
            found["event_id"] = pd.array(found["event_id"], dtype="Int64")
            found["timestamp"] = pd.to_datetime(found["timestamp"], unit="us")
            yield found

    slim = events.select(
        F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"),
        "session_id",
        F.coalesce("event_id", F.lit(0).cast("long")).alias("event_id"),
        "event_type",
        F.unix_micros("timestamp").alias("at"),
        "timestamp",
    ).withWatermark("timestamp", lateness)
    return slim.groupBy("bucket").applyInPandasWithState(
        run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
