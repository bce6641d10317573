"""Every registered query against its SQL on the smallest tables."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from comparing import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sql, name):
    assert difference(entry.queries()[name](spark, SF), sql, entry.oracle_sql()[name]) is None


def test_expired_sessions_are_the_closed_visits(spark):
    ended = entry.queries()["stream_session_expiry"](spark, SF)
    visits = entry.queries()["visits"](spark, SF).drop("visit")
    assert ended.exceptAll(visits.select(*ended.columns)).isEmpty()
    # Only visits within reach of the watermark at the end of the data are still open.
    left = visits.select(*ended.columns).exceptAll(ended)
    newest = visits.agg({"last_at": "max"}).first()[0]


    assert all(newest - r["last_at"] <= dt.timedelta(hours=13) for r in left.collect())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["track_id", "n"] and df.count() == 10
