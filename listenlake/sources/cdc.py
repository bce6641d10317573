"""Change-data-capture streams: reading topics and parsing change envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Row images of the three captured tables; times are micros since the epoch.
# Columns of the captured tables.
SESSION_ROW = """
event_id bigint, event_type string, session_id string, user_id string, track_id string, bitrate string,
new_bitrate int, acked_chunk_count int, total_chunks_sent int, new_chunk_offset int, old_chunk_offset int,
timestamp bigint
"""
PLAYLIST_ROW = "event_id bigint, event_type string, playlist_id int, track_id int, user_id int, timestamp bigint"
USER_ROW = "event_id bigint, event_type string, user_id string, timestamp bigint"

ROWS = {"session_events": SESSION_ROW, "playlist_events": PLAYLIST_ROW, "users_events": USER_ROW}


def columns(row: str) -> list[str]:
    """A captured table's columns, in order."""
    return [field.split()[0] for field in row.replace("\n", " ").split(",")]


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """Unbounded read of one topic with headers (needs the Kafka connector on the classpath)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("includeHeaders", "true")
        .load()
    )


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded read of a folder of JSON lines, as a ``value`` column."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def _image(row: str) -> str:
    """A table's columns as a struct type."""
    return f"struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in ' '.join(row.split()).split(','))}>"


def _payload(fields: str) -> Column:
    """The given fields of an envelope; nothing else in it is parsed."""
    return F.from_json(F.col("value").cast("string"), f"payload struct<{fields}>")["payload"]


def changes(lines: DataFrame, row: str) -> DataFrame:
    """Envelopes with both row images and the kind of change; other columns are kept.

    A value that is no envelope gives nulls.
    """
    image = _image(row)
    payload = _payload(f"before: {image}, after: {image}, op: string")
    kept = [c for c in lines.columns if c != "value"]
    # Generated columns keep later filters above the parsing, so each value is parsed once.
    return lines.select(*kept, F.inline(F.array(payload)))


def partial_changes(lines: DataFrame, row: str, position: str) -> DataFrame:
    """Envelopes for ``ChangeTable``: kind, position, the new image's columns and which of them it holds.

    Of a delete, the old image gives the key. A value that is no envelope gives nulls.
    """
    fields = columns(row)
    key = fields[0]
    names = F.json_object_keys(F.get_json_object(F.col("value").cast("string"), "$.payload.after"))
    log = changes(lines.select("value", position, names.alias("_names")), row)
    return log.select(
        "op",
        F.col(position).alias("position"),
        F.coalesce(f"after.{key}", f"before.{key}").alias(key),
        F.coalesce("_names", F.array().cast("array<string>")).alias("present"),
        *[f"after.{c}" for c in fields[1:]],
    )


def parse(lines: DataFrame, row: str) -> DataFrame:
    """Typed rows of inserts and updates, appended as they come.

    Deletes, nulls and garbage have no new image and so no key; they are left out.
    """
    after = lines.select(F.inline(F.array(_payload(f"after: {_image(row)}")))).select("after.*")
    after = after.where(F.col("event_id").isNotNull())
    return after.withColumn("timestamp", F.timestamp_micros("timestamp"))


def canonical_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text ids as numbers; what is not a number stays null and is named in ``problem``."""
    bad = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast("long").isNull(), F.lit(c)) for c in columns])
    )
    return df.withColumn("problem", F.when(F.size(bad) > 0, F.concat_ws(",", bad))).withColumns(
        {c: F.col(c).try_cast("long") for c in columns}
    )
