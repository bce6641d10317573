"""Ordered scans: groups scanned in pieces give what one window gives."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from listenlake.operators import machine, ordered, playlists, sessions
from listenlake.operators.ordered import OrderedRows


@pytest.fixture(params=[1 << 20, 150, 0], autouse=True)
def most(request, monkeypatch):
    """No group, some groups or all of them are cut."""
    monkeypatch.setattr(ordered, "MOST_ROWS", request.param)
    return request.param


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        data.append((key, rng.randint(0, 40), i, rng.choice([None, 1, 2, 3]), rng.choice(["x", None, "y"])))
    data += [("single", 1, 1000, None, None), ("six", 1, 2000, 1, "x")]
    data += [("six", 1, 2001 + i, None, None) for i in range(5)]
    return spark.createDataFrame(data, "k string, t int, id int, v int, s string").repartition(4)


def _scans():
    return {
        "number": ordered.row_number(),
        "total": ordered.running_sum(F.col("v")),
        "last": ordered.last_seen(F.col("v")),
        "before": ordered.last_before(F.col("s")),
        "prev": ordered.previous(F.col("s")),
        "next": ordered.following(F.col("v")),
    }


def _whole(df, order):
    """The same scans, each group in one window."""
    window = Window.partitionBy("k").orderBy(*ordered.order_columns(order))
    return df.withColumns({n: ordered._local(s, window) for n, s in _scans().items()})


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "id"], ["t", "-id"]])
def test_parts_equal_whole_groups(rows, order):
    parts = sorted(map(str, OrderedRows.of(rows, ["k"], order).add(**_scans()).frame().collect()))
    assert parts == sorted(map(str, _whole(rows, order).collect()))


def test_groups_are_cut_and_no_window_holds_a_group(rows, most):
    if most > 300:
        pytest.skip("nothing is cut")
    scans = OrderedRows.of(rows, ["k"], ["t", "id"])
    assert scans.rows.where("k = 'hot'").select("_chunk").distinct().count() > 1
    plan = scans.add(**_scans()).frame()._jdf.queryExecution().optimizedPlan().toString()
    partitioned = [line for line in plan.splitlines() if re.search(r"Window \[", line)]
    # Only the scan over one row for each part of a group is partitioned by the group alone.
    whole = [line for line in partitioned if not re.search(r"\], \[_chunk#\d+, k#\d+\], \[", line)]
    assert len(partitioned) > len(whole) and all("_h_" in line for line in whole)


def test_second_scan_on_parts(rows):
    df = rows.withColumn("ts", F.timestamp_seconds(F.col("t") * 600))
    got = {(r["k"], r["id"]): r["visit"] for r in sessions.sessionize(df, "k", "ts", "id", 1200).collect()}
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r["k"], []).append((r["t"] * 600, r["id"]))
    for key, own in by_key.items():
        visit, before = 0, None
        for ts, id_ in sorted(own):
            visit += before is None or ts - before >= 1200
            assert got[(key, id_)] == visit
            before = ts


def test_renumbering_is_a_permutation(spark):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 2]), i, rng.randint(0, 99)) for i in range(200)]
    tracks = spark.createDataFrame(data, "playlist_id int, track_id int, position int").withColumn("added_at", F.lit(0))
    result = playlists.renumber(tracks).collect()
    for playlist in (1, 2):
        mine = [r for r in result if r["playlist_id"] == playlist]
        assert sorted(r["position"] for r in mine) == list(range(len(mine)))
        old = {t: (p, t) for k, t, p in data if k == playlist}
        in_order = [r["track_id"] for r in sorted(mine, key=lambda r: r["position"])]
        assert in_order == sorted(in_order, key=lambda t: old[t])


def test_one_shuffle_serves_a_chain_of_scans(rows, most):
    if most < 1000:
        pytest.skip("groups are cut")
    chain = OrderedRows.of(rows, ["k"], ["t", "id"]).add(**_scans()).add(again=ordered.running_sum(F.col("number")))
    plan = chain.frame()._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


STRIP = machine.Machine(("a", "b", "c", "d", "e"), {"x": {"a": "b", "b": "c"}, "y": {"c": "a", "e": "d"}, "z": {"a": "e", "b": "a", "d": "c"}})


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "id"]])
def test_states_equal_a_walk(rows, order):
    got = machine.fold(OrderedRows.of(rows, ["k"], order), STRIP, "s", "was", "now").frame().collect()
    sign = -1 if order[0] == "-t" else 1
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append(r)
    assert sum(map(len, by_key.values())) == rows.count()
    for own in by_key.values():
        state = "a"
        for r in sorted(own, key=lambda r: (sign * r["t"], r["id"])):
            assert r["was"] == state
            state = STRIP.moves.get(r["s"], {}).get(state, state)
            assert r["now"] == state


def test_prefixes_of_functions():
    import numpy as np

    draw = np.random.default_rng(6)
    for n in (0, 1, 2, 17, 1000):
        maps, first = draw.integers(0, 5, (n, 5)), draw.random(n) < 0.05
        before = draw.integers(0, 5, 5)
        found, run = machine.prefixes(maps, first, before), before
        for i in range(n):
            run = maps[i] if first[i] else maps[i][run]
            assert (found[i] == run).all()
    with pytest.raises(ValueError):
        machine.Machine((), {})


def test_many_events_of_one_session(spark):
    n = 100_000
    kinds = ["SessionPaused", "SessionResumed", "SessionStarted", "ChunksAckEvent", "SessionPaused"]
    events = spark.range(n).select(
        F.lit("s").alias("session_id"),
        F.col("id").alias("event_id"),
        F.timestamp_seconds("id").alias("timestamp"),
        F.when(F.col("id") == n - 50, "SessionStopped").otherwise(F.element_at(F.array(*map(F.lit, kinds)), (F.hash("id") % 5 + 5).cast("int") % 5 + 1)).alias("event_type"),
    )
    state = "NONE"
    for r in sorted(sessions.strict_states(events).collect(), key=lambda r: r["event_id"]):
        allowed = state in sessions.ALLOWED_BEFORE[r["event_type"]]
        assert (r["state_before"], r["legal"]) == (state, allowed)
        state = sessions.STATE_AFTER.get(r["event_type"], state) if allowed else state
        assert r["state_after"] == state
    assert state == "STOPPED"
