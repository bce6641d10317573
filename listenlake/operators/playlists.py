"""Playlists: membership, order, ownership, subscriptions and deletes, as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.functions.rules import visible
from listenlake.operators import ordered
from listenlake.operators.ordered import OrderedRows
from listenlake.session import fine_pieces


def owners(playlist_users: DataFrame) -> DataFrame:
    return playlist_users.where("is_creator").select("playlist_id", F.col("user_id").alias("owner_id"))


def of_user(playlists: DataFrame, playlist_users: DataFrame, user_id: int) -> DataFrame:
    """Playlists a user belongs to, each once."""
    mine = playlist_users.where(F.col("user_id") == user_id).select("playlist_id")
    return playlists.join(mine, "playlist_id", "left_semi")


def with_members(playlists: DataFrame, playlist_tracks: DataFrame, playlist_users: DataFrame) -> DataFrame:
    """Playlists with their tracks and their users, one row per member.

    ``kind`` is track or user, so that tracks and users of a playlist do not multiply; a
    playlist without members keeps one row without a kind.
    """
    tracks = playlist_tracks.select(
        "playlist_id", F.lit("track").alias("kind"), F.col("track_id").alias("member_id"), "position",
        F.lit(None).cast("boolean").alias("is_creator"),
    )
    users = playlist_users.select(
        "playlist_id", F.lit("user").alias("kind"), F.col("user_id").alias("member_id"),
        F.lit(None).cast(playlist_tracks.schema["position"].dataType).alias("position"), "is_creator",
    )
    return playlists.join(tracks.unionByName(users), "playlist_id", "left")



def with_track(playlists: DataFrame, playlist_tracks: DataFrame, track_id: int) -> DataFrame:
    """Playlists containing a track, each once."""
    holding = playlist_tracks.where(F.col("track_id") == track_id).select("playlist_id")
    return playlists.join(holding, "playlist_id", "left_semi")


def of_every_user(playlists: DataFrame, playlist_users: DataFrame) -> DataFrame:
    """Each user's playlists, one row per user and playlist."""
    links = playlist_users.groupBy("user_id", "playlist_id").agg(F.max("is_creator").alias("is_creator"))
    return links.join(playlists, "playlist_id")


def of_every_track(playlists: DataFrame, playlist_tracks: DataFrame) -> DataFrame:
    """The playlists holding each track, one row per track and playlist."""
    return playlist_tracks.select("track_id", "playlist_id").distinct().join(playlists, "playlist_id")


def assemble(playlists: DataFrame, playlist_users: DataFrame, playlist_tracks: DataFrame) -> DataFrame:
    """Playlists with owner and tracks: one row per track, one with nulls for an empty playlist.

    Rows carry ``position`` instead of sitting in one array, so a playlist of any length is
    spread like other rows.
    """
    return playlists.join(owners(playlist_users), "playlist_id", "left").join(playlist_tracks, "playlist_id", "left")


def visible_to(playlists: DataFrame, playlist_users: DataFrame, requester: int) -> DataFrame:
    """Public playlists, and those the requester owns."""
    owned = playlists.join(owners(playlist_users), "playlist_id", "left")
    return owned.where(visible(F.col("is_public"), F.col("owner_id"), F.lit(requester)))


def check_adds(adds: DataFrame, playlist_users: DataFrame, playlist_tracks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Why each requested add (playlist, track, user) is refused, or 'ok'."""
    known = tracks.select("track_id", F.lit(True).alias("_known")).distinct()
    present = playlist_tracks.select("playlist_id", "track_id", F.lit(True).alias("_present")).distinct()
    return (
        adds.join(known, "track_id", "left")
        .join(owners(playlist_users), "playlist_id", "left")
        .join(present, ["playlist_id", "track_id"], "left")
        .select(
            *adds.columns,
            F.when(F.col("_known").isNull(), "unknown track")
            .when(~F.col("owner_id").eqNullSafe(F.col("user_id")), "not the owner")
            .when(F.col("_present"), "already in playlist")
            .otherwise("ok")
            .alias("outcome"),
        )
    )


def track_counts(playlists: DataFrame, playlist_tracks: DataFrame) -> DataFrame:
    """Every playlist with its number of tracks, 0 when empty."""
    counts = playlist_tracks.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("track_count"))
    return playlists.join(counts, "playlist_id", "left").withColumn(
        "track_count", F.coalesce("track_count", F.lit(0))
    )


def tracks_with_titles(playlist_tracks: DataFrame, tracks: DataFrame) -> DataFrame:
    return playlist_tracks.join(tracks.select("track_id", "title", "duration_ms"), "track_id").select(
        "playlist_id", "position", "track_id", "title", "duration_ms"
    )


def subscribers(playlist_users: DataFrame, users: DataFrame) -> DataFrame:
    """Users subscribed to each playlist, without its creator."""
    subscribed = playlist_users.where(~F.coalesce("is_creator", F.lit(False)))
    return subscribed.join(users.select("user_id", "username"), "user_id").select("playlist_id", "user_id", "username")


def new_subscriptions(requests: DataFrame, playlists: DataFrame, playlist_users: DataFrame) -> DataFrame:
    """Requested subscriptions that may be stored: public playlist, not linked yet, once each."""
    public = playlists.where("is_public").select("playlist_id")
    return (
        requests.select("playlist_id", "user_id")
        .distinct()
        .join(public, "playlist_id", "left_semi")
        .join(playlist_users.select("playlist_id", "user_id"), ["playlist_id", "user_id"], "left_anti")
    )


def membership_flags(
    pairs: DataFrame, links: DataFrame, keys: list[str], flag: str
) -> DataFrame:
    """Each pair with a flag telling whether ``links`` holds it."""
    held = links.select(*keys).distinct().withColumn(flag, F.lit(True))
    return pairs.join(held, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def next_positions(playlist_tracks: DataFrame) -> DataFrame:
    """Position the next added track gets: largest plus one."""
    return playlist_tracks.groupBy("playlist_id").agg(
        (F.coalesce(F.max("position"), F.lit(0)) + 1).alias("next_position")
    )


def renumber(playlist_tracks: DataFrame, base: int = 0) -> DataFrame:
    """Consecutive positions from ``base``, in the old order."""
    rows = OrderedRows.of(playlist_tracks, ["playlist_id"], ["position", "track_id", "added_at"])
    numbered = rows.add(_n=ordered.row_number()).frame()
    return numbered.withColumn("position", F.col("_n") - 1 + base).drop("_n")


def remove_and_renumber(playlist_tracks: DataFrame, removals: DataFrame, base: int = 0) -> DataFrame:
    """Remove (playlist, track) rows, then close the gaps."""
    kept = playlist_tracks.join(removals.select("playlist_id", "track_id"), ["playlist_id", "track_id"], "left_anti")
    return renumber(kept, base)


def append(playlist_tracks: DataFrame, additions: DataFrame) -> DataFrame:
    """Positions for new tracks after each playlist's last one.

    A track already in the playlist is refused; one requested twice is added once, at its
    first request. ``additions`` holds playlist_id, track_id, added_at.
    """
    wanted = fine_pieces(additions, "playlist_id", "track_id").groupBy("playlist_id", "track_id").agg(F.min("added_at").alias("added_at"))
    fresh = wanted.join(playlist_tracks.select("playlist_id", "track_id"), ["playlist_id", "track_id"], "left_anti")
    numbered = (
        OrderedRows.of(fresh, ["playlist_id"], ["added_at", "track_id"]).add(_n=ordered.row_number()).frame()
    )
    return (
        numbered.join(next_positions(playlist_tracks), "playlist_id", "left")
        .withColumn("position", F.coalesce("next_position", F.lit(1)) + F.col("_n") - 1)
        .select("playlist_id", "track_id", "position", "added_at")
    )


def drop_users(playlist_users: DataFrame, deleted: DataFrame) -> DataFrame:
    """Links left after users are deleted."""
    return playlist_users.join(deleted.select("user_id"), "user_id", "left_anti")


def drop_playlists(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of a playlist table left after playlists are deleted."""
    return table.join(deleted.select("playlist_id"), "playlist_id", "left_anti")


def affected(table: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows each deletion removes, per key; keys without rows count 0."""
    lost = table.join(deleted.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return deleted.select(key).distinct().join(lost, key, "left").select(
        key, F.coalesce("_n", F.lit(0)).alias("affected")
    )
