"""Edge values of row rules, guards and column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listenlake.functions import rules, scalars


def _column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_lengths(spark):
    names = ["ab", "abc", "a" * 15, "a" * 16]
    assert _column(spark, names, rules.valid_username_length) == [False, True, True, False]
    titles = ["", "x", "x" * 99, "x" * 100]
    assert _column(spark, titles, rules.valid_playlist_title) == [False, True, True, False]
    tracks = ["", "x", "x" * 255, "x" * 256]
    assert _column(spark, tracks, rules.valid_track_title) == [False, True, True, False]


def test_email_and_names(spark):
    emails = ["test@example.com", "a.b+c@x-y.co.uk", "no-at.example.com", "a@b", "a b@c.de", None]
    assert _column(spark, emails, rules.valid_email) == [True, True, False, False, False, None]
    assert _column(spark, ["testuser", "тест1", "a_b", "", "a b"], rules.alphanumeric) == [True, True, False, False, False]


def test_numbers(spark):
    assert _column(spark, [128, 192, 320, 256], rules.valid_bitrate, "int") == [True, True, True, False]
    assert _column(spark, [0, 1, -1], rules.positive, "int") == [False, True, False]
    assert _column(spark, [-1, 0, 10, 11], lambda v: rules.offset_inside(v, F.lit(10)), "int") == [False, True, True, False]


def test_counted_listen(spark):
    df = spark.createDataFrame([(49, 100), (50, 100), (0, 0), (51, 100)], "sent long, total long")
    kept = df.select(
        rules.counts_as_listen(F.col("sent"), F.col("total")), scalars.listened_pct(F.col("sent"), F.col("total"))
    ).collect()
    assert [tuple(r) for r in kept] == [(False, 49.0), (True, 50.0), (True, None), (True, 51.0)]


def test_failed_rules_treats_null_as_broken(spark):
    df = spark.createDataFrame([(None,), (5,), (-5,)], "v int")
    out = [r[0] for r in df.select(rules.failed_rules({"positive": F.col("v") > 0, "small": F.col("v") < 0})).collect()]
    assert out == [["positive", "small"], ["small"], ["positive"]]


def test_chunks(spark):
    sizes = [0, 1, 511, 512, 513]
    assert _column(spark, sizes, lambda v: scalars.total_chunks(v, 512), "long") == [0, 1, 1, 1, 2]
    row = spark.range(1).select(
        scalars.seconds_offset(F.lit(-5.0), F.lit(128), F.lit(1000)),
        scalars.seconds_offset(F.lit(1.0), F.lit(128), F.lit(1000)),
        scalars.seconds_offset(F.lit(0.03), F.lit(128), F.lit(1000)),
        scalars.carried_offset(F.lit(16000), F.lit(128), F.lit(320), F.lit(100000)),
    ).first()
    assert tuple(row) == (0, 999, 480, 40000)


def test_object_paths(spark):
    paths = ["tracks/7/320.mp3", "s3a://b/tracks/7/x.mp3", "tracks/7/128.wav", "tracks/a/128.mp3"]
    assert _column(spark, paths, scalars.object_track) == [7, 7, None, None]
    assert _column(spark, paths, scalars.object_bitrate) == [320, None, None, 128]


def test_time(spark):
    row = spark.range(1).select(
        scalars.from_micros(F.lit(1_700_000_000_123_456)),
        scalars.from_proto_time(F.lit(1_700_000_000), F.lit(123_456_789)),
        scalars.grain(F.lit(dt.datetime(2024, 5, 17, 23, 59)), "P1M"),
        scalars.grain(F.lit(dt.datetime(2024, 5, 17, 23, 59)), "P1D"),
        scalars.parse_iso_day(F.lit("2024-02-30")),
        scalars.parse_iso_day(F.lit("2024-02-29")),
    ).first()
    stamp = dt.datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert row[0] == row[1] == stamp
    assert list(row[2:]) == [dt.date(2024, 5, 1), dt.date(2024, 5, 17), None, dt.date(2024, 2, 29)]


def test_lists(spark):
    df = spark.createDataFrame([([1, 2], [{"id": 1}, {"id": 2}])], "a array<int>, b array<struct<id: int>>")
    row = df.select(
        scalars.list_add(F.col("a"), F.lit(2)),
        scalars.list_add(F.col("a"), F.lit(3)),
        F.size(scalars.list_drop(F.col("b"), "id", 1)),
        scalars.empty_to_null(F.slice("a", 1, 0)),
    ).first()
    assert list(row) == [[1, 2], [1, 2, 3], 1, None]


def test_snapshot_leaves_out_missing_times(spark):
    df = spark.sql("SELECT named_struct('session_id', 's', 'paused_at', CAST(NULL AS STRING), 'status', 'PAUSED') AS s")
    row = df.select(scalars.snapshot_json(F.col("s")).alias("j")).select(
        "j", scalars.snapshot_from_json(F.col("j"))["paused_at"], scalars.snapshot_from_json(F.col("j"))["status"]
    ).first()
    assert tuple(row) == ('{"session_id":"s","status":"PAUSED"}', None, "PAUSED")


def test_guards():
    for bad in [(0, 10), (1, 0), (1, 101)]:
        with pytest.raises(ValueError):
            rules.check_page(*bad)
    for bad in [(0, 0), (101, 0), (10, -1)]:
        with pytest.raises(ValueError):
            rules.check_limit(*bad)
    with pytest.raises(ValueError):
        rules.check_any_filter(title="", genres=[], explicit=None)
    rules.check_any_filter(explicit=False)


def test_open_and_closed_ranges(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "v int")
    assert df.where(rules.time_range("v", 1, 3)).count() == 2
    assert df.where(rules.time_range("v")).count() == 5
    assert df.where(rules.closed_range("v", 1, 3)).count() == 3
    assert df.where(rules.closed_range("v", high=3)).count() == 4
