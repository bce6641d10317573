"""Work that must not grow with a task: groups dealt finely, tables of keys made once."""

from pyspark.sql import functions as F

from listenlake.operators import playlists, search
from listenlake.plans import live


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_grouped_in_one_fine_deal_of_the_documents(spark):
    rows = [(1, "red red ring", ["Band"]), (1, "red red ring", ["Band"]), (2, "ring", None)]
    found = search.postings(spark.createDataFrame(rows, "track_id long, title string, artists array<string>"))
    got = sorted((r["field"], r["token"], r["track_id"], r["length"], r["tf"]) for r in found.collect())
    assert got == [("artist_name", "band", 1, 1, 2), ("title", "red", 1, 3, 4), ("title", "ring", 1, 3, 2), ("title", "ring", 2, 1, 1)]
    plan = _plan(found)
    assert "hashpartitioning(track_id" in plan and "hashpartitioning(field" not in plan
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange ") > 0


def test_additions_are_grouped_in_fine_pieces(spark):
    schema = "playlist_id long, track_id long, position int, added_at timestamp"
    held = spark.createDataFrame([], schema)
    asked = spark.range(6).select(F.lit(1).cast("long").alias("playlist_id"), (F.col("id") % 3).alias("track_id"), F.timestamp_seconds("id").alias("added_at"))
    found = playlists.append(held, asked)
    assert sorted((r["track_id"], r["position"]) for r in found.collect()) == [(0, 1), (1, 2), (2, 3)]
    assert "REPARTITION_BY_NUM" in _plan(found)


def test_cascaded_tables_are_written_keys(spark):
    rows = spark.createDataFrame([(1, 2, "x"), (3, 4, "y")], "user_id long, other long, name string")
    table = live._stored_keys(rows, "history")
    assert table().columns == ["user_id"] and table().count() == 2
    assert all("cascade-history" in f for f in table().inputFiles())
