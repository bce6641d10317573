"""Catalogue: denormalised and nested tracks, bridge reconciliation, dimension changes, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions import scalars
from listenlake.operators import ordered
from listenlake.operators.ordered import OrderedRows
from listenlake.operators.paging import first_of_each


def _names_per_track(bridge: DataFrame, side: DataFrame, key: str, out: str) -> DataFrame:
    """Sorted distinct names per track; duplicates go before names are gathered."""
    named = bridge.join(side.select(key, "name"), key).select("track_id", "name").distinct()
    return named.groupBy("track_id").agg(F.array_sort(F.collect_list("name")).alias(out))


def search_documents(
    tracks: DataFrame, track_artists: DataFrame, artists: DataFrame, track_genres: DataFrame, genres: DataFrame
) -> DataFrame:
    """One document per track: title, length, distinct artist and genre names.

    Each side is gathered on its own before it meets the track, so two artists and two
    genres make two rows each instead of four.
    """
    none = F.array().cast("array<string>")
    return (
        tracks.join(_names_per_track(track_artists, artists, "artist_id", "artists"), "track_id", "left")
        .join(_names_per_track(track_genres, genres, "genre_id", "genres"), "track_id", "left")
        .select(
            "track_id",
            "title",
            "duration_ms",
            F.coalesce("artists", none).alias("artists"),
            F.coalesce("genres", none).alias("genres"),
            "explicit",
            scalars.iso_day(F.col("release_date")).alias("release_date"),
        )
    )


def _members(bridge: DataFrame, side: DataFrame, key: str, member: Column, out: str) -> DataFrame:
    return (
        bridge.select("track_id", key).distinct().join(side, key)
        .groupBy("track_id")
        .agg(F.array_sort(F.collect_list(member)).alias(out))
    )


def nested_tracks(
    tracks: DataFrame, track_artists: DataFrame, artists: DataFrame, track_genres: DataFrame, genres: DataFrame
) -> DataFrame:
    """Tracks with their artists and genres as lists of structs, ordered by id."""
    artist = F.struct("artist_id", "name", F.col("verified").alias("is_verified"))
    genre = F.struct("genre_id", "name")
    nested = tracks.join(_members(track_artists, artists, "artist_id", artist, "artists"), "track_id", "left").join(
        _members(track_genres, genres, "genre_id", genre, "genres"), "track_id", "left"
    )
    return nested.withColumns(
        {
            "artists": F.coalesce("artists", F.array().cast(nested.schema["artists"].dataType)),
            "genres": F.coalesce("genres", F.array().cast(nested.schema["genres"].dataType)),
        }
    )


def tracks_of(tracks: DataFrame, bridge: DataFrame, where: Column) -> DataFrame:
    """Tracks linked to the bridge rows that match (one artist, one genre)."""
    return tracks.join(bridge.where(where).select("track_id"), "track_id", "left_semi")


def tracks_in_genre(tracks: DataFrame, track_genres: DataFrame, genres: DataFrame, name: str) -> DataFrame:
    chosen = genres.where(F.col("name") == name).select("genre_id")
    return tracks.join(track_genres.join(chosen, "genre_id", "left_semi"), "track_id", "left_semi")


def first_tracks_of_each(tracks: DataFrame, bridge: DataFrame, key: str, n: int) -> DataFrame:
    """The first page of tracks of every artist or genre at once."""
    linked = bridge.select("track_id", key).distinct().join(tracks, "track_id")
    return first_of_each(linked, [key], ["track_id"], n)


def tracks_with_bitrates(tracks: DataFrame, track_bitrates: DataFrame, objects: DataFrame) -> DataFrame:
    """Bitrates declared for each track beside those found in storage (both highest first)."""

    def rates(df: DataFrame, out: str) -> DataFrame:
        once = df.where(F.col("bitrate").isNotNull()).select("track_id", "bitrate").distinct()
        return once.groupBy("track_id").agg(F.sort_array(F.collect_list("bitrate"), asc=False).alias(out))

    found = rates(
        objects.select(
            scalars.object_track(F.col("path")).alias("track_id"),
            scalars.object_bitrate(F.col("path")).alias("bitrate"),
        ).where(F.col("track_id").isNotNull()),
        "stored",
    )
    declared = rates(track_bitrates, "declared")
    none = F.array().cast("array<int>")
    return (
        tracks.select("track_id", "title")
        .join(declared, "track_id", "left")
        .join(found, "track_id", "left")
        .withColumn("declared", F.coalesce("declared", none))
        .withColumn("stored", F.coalesce("stored", none))
        .withColumn("agrees", F.col("declared") == F.col("stored"))
    )


def bitrate_mismatches(track_bitrates: DataFrame, objects: DataFrame) -> DataFrame:
    """(track, bitrate) pairs declared but not stored, or stored but not declared."""
    stored = objects.select(
        scalars.object_track(F.col("path")).alias("track_id"), scalars.object_bitrate(F.col("path")).alias("bitrate")
    ).where("track_id is not null and bitrate is not null").distinct()
    declared = track_bitrates.select("track_id", "bitrate").distinct()
    both = declared.withColumn("d", F.lit(True)).join(
        stored.withColumn("s", F.lit(True)), ["track_id", "bitrate"], "full_outer"
    )
    return both.where(F.col("d").isNull() | F.col("s").isNull()).select(
        "track_id", "bitrate", F.when(F.col("d").isNull(), "undeclared").otherwise("missing").alias("problem")
    )


def available_bitrates(objects: DataFrame) -> DataFrame:
    """Numeric bitrates of each stored track, highest first."""
    pairs = objects.select(
        scalars.object_track(F.col("path")).alias("track_id"), scalars.object_bitrate(F.col("path")).alias("bitrate")
    )
    return (
        pairs.where("track_id is not null and bitrate is not null").distinct()
        .groupBy("track_id")
        .agg(F.sort_array(F.collect_list("bitrate"), asc=False).alias("bitrates"))
    )


def reconcile(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Bridge rows to add and to delete so that ``existing`` becomes ``wanted``.

    Both sides are tagged and counted per row, one shuffle with partial sums instead of two
    anti joins.
    """
    tagged = existing.select(*keys, F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        wanted.select(*keys, F.lit(0).alias("old"), F.lit(1).alias("new"))
    )
    sides = tagged.groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return sides.where("old <> new").select(*keys, F.when(F.col("new") == 1, "add").otherwise("delete").alias("action"))


def apply_reconciled(existing: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    added = actions.where("action = 'add'").select(*keys)
    dropped = actions.where("action = 'delete'").select(*keys)
    return existing.select(*keys).distinct().join(dropped, keys, "left_anti").unionByName(added)


def apply_changes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Inserts, partial updates and deletes on a dimension table, as one join.

    ``changes`` holds one row per key with ``op`` ('upsert' or 'delete') and any of the
    base's columns; a null or missing column keeps the old value.
    """
    supplied = [c for c in changes.columns if c not in (key, "op")]
    renamed = changes.select(key, F.col("op").alias("_op"), *[F.col(c).alias(f"_new_{c}") for c in supplied])
    merged = base.join(renamed, key, "full_outer").where(~F.col("_op").eqNullSafe("delete"))
    return merged.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in supplied else F.col(c) for c in base.columns]
    )


def change_counts(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """How many rows each kind of change touches."""
    known = base.select(key, F.lit(True).alias("_known"))
    kind = (
        F.when((F.col("op") == "delete") & F.col("_known"), "deleted")
        .when(F.col("op") == "delete", "ignored")
        .when(F.col("_known"), "updated")
        .otherwise("inserted")
    )
    return changes.join(known, key, "left").groupBy(kind.alias("change")).agg(F.count(F.lit(1)).alias("affected"))


def assign_ids(new_rows: DataFrame, existing: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """Ids for new rows, continuing after the largest existing one, in ``order``.

    Rows are dealt out by range and counted inside their part; each part starts where the parts
    before it end, so what one task gathers is a row per part. ``order`` should identify a row.
    """
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    numbered = OrderedRows.of(new_rows, [], order).add(_n=ordered.row_number()).frame()
    return numbered.withColumn(id_column, F.col("_n") + top).drop("_n")
