"""Listening history and likes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.functions.rules import counts_as_listen


def counted(listens: DataFrame) -> DataFrame:
    """Listens of at least half the track."""
    return listens.where(counts_as_listen(F.col("total_chunks_sent"), F.col("total_chunks")))


def latest(listens: DataFrame) -> DataFrame:
    """History: the latest counted listen of each (user, track)."""
    return counted(listens).groupBy("user_id", "track_id").agg(F.max("timestamp").alias("timestamp"))


def first_likes(likes: DataFrame) -> DataFrame:
    """Likes: the first like of each (user, track) wins."""
    return likes.groupBy("user_id", "track_id").agg(F.min("liked_at").alias("liked_at"))


def accepted_likes(likes: DataFrame, tracks: DataFrame) -> DataFrame:
    """First likes of tracks that exist."""
    return first_likes(likes).join(tracks.select("track_id"), "track_id", "left_semi")


def drop_users(table: DataFrame, deleted: DataFrame) -> DataFrame:
    return table.join(deleted.select("user_id"), "user_id", "left_anti")
