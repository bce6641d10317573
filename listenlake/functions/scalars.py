"""Column functions: cleaning, time, object paths, chunk arithmetic, keys, list edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO day format, date grains, public session states.
ISO_DAY = "yyyy-MM-dd"
GRAINS = {"P1D": "day", "P1M": "month", "P1Y": "year"}
PUBLIC_STATUS = {"PAUSED": "PAUSED", "STOPPED": "STOPPED"}
OTHER_STATUS = "ACTIVE"


# -- nulls and sentinels ---------------------------------------------------------------


def or_default(value: Column, default) -> Column:
    """Null becomes the sink's typed default ('' or 0)."""
    return F.coalesce(value, F.lit(default))


def sentinel_to_null(value: Column, sentinel) -> Column:
    """Wire sentinel ('' or 0) becomes null."""
    return F.nullif(value, F.lit(sentinel))


def empty_to_null(values: Column) -> Column:
    """Empty list becomes null."""
    return F.when(F.size(values) > 0, values)


def page_defaults(page: Column, page_size: Column, default_size: int = 50) -> tuple[Column, Column]:
    """Page 1 and the default size where the request carries 0 or nothing."""
    return (
        F.coalesce(sentinel_to_null(page, 0), F.lit(1)),
        F.coalesce(sentinel_to_null(page_size, 0), F.lit(default_size)),
    )


def without_nulls(values: Column) -> Column:
    return F.array_compact(values)


# -- time ------------------------------------------------------------------------------


def from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def from_proto_time(seconds: Column, nanos: Column) -> Column:
    """Seconds and nanos since the epoch, in UTC, to microsecond precision."""
    return F.timestamp_micros(seconds.cast("long") * 1_000_000 + F.floor(nanos / 1000))


def iso_day(day: Column) -> Column:
    return F.date_format(day, ISO_DAY)


def parse_iso_day(text: Column) -> Column:
    """ISO text to date; null where it is no date."""
    return F.try_to_timestamp(text, F.lit(ISO_DAY)).cast("date")


def grain(ts: Column, code: str) -> Column:
    """Start of the day, month or year, as a date."""
    unit = GRAINS[code]
    return ts.cast("date") if unit == "day" else F.trunc(ts.cast("date"), unit)


# -- stored audio objects --------------------------------------------------------------


def object_track(path: Column) -> Column:
    """Track id of ``…/<track>/<bitrate>.mp3``; null for other paths."""
    return F.regexp_extract(path, r"([0-9]+)/[^/]+\.mp3$", 1).try_cast("long")


def object_bitrate(path: Column) -> Column:
    """Bitrate of ``…/<track>/<bitrate>.mp3``; null where it is not a number."""
    return F.regexp_extract(path, r"/([0-9]+)\.mp3$", 1).try_cast("int")


def total_chunks(size: Column, chunk: int) -> Column:
    """Chunks needed for an object: size / chunk, rounded up."""
    return F.floor((size + (chunk - 1)) / chunk).cast("long")


def bytes_per_second(bitrate: Column) -> Column:
    return bitrate * 1000 / 8


def estimated_seconds(size: Column, bitrate: Column) -> Column:
    return size.cast("long") * 8 / (bitrate * 1000)


def offset_seconds(offset: Column, bitrate: Column) -> Column:
    return offset / bytes_per_second(bitrate)


def seconds_offset(seconds: Column, bitrate: Column, size: Column) -> Column:
    """Byte offset of a time, kept inside the object."""
    raw = F.floor(seconds * bytes_per_second(bitrate)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(raw, size - 1))


def carried_offset(offset: Column, old_bitrate: Column, new_bitrate: Column, new_size: Column) -> Column:
    """Offset with the same playing time after a bitrate switch."""
    return seconds_offset(offset_seconds(offset, old_bitrate), new_bitrate, new_size)


def chunk_number(offset: Column, chunk: int) -> Column:
    return F.floor(offset / chunk).cast("long")


def duration_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def listened_pct(sent: Column, total: Column) -> Column:
    """Share of the track sent, in percent to one decimal; null for an empty track."""
    return F.round(100 * sent / F.nullif(total, F.lit(0)), 1)


# -- keys, labels, states --------------------------------------------------------------


def fingerprint(columns: list[str]) -> Column:
    """Digest of the row's canonical JSON: keys sorted, nulls kept."""
    fields = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.md5(F.to_json(fields, {"ignoreNullFields": "false"}))


def cache_key(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def public_status(status: Column) -> Column:
    known = None
    for inner, outer in PUBLIC_STATUS.items():
        known = F.when(status == inner, outer) if known is None else known.when(status == inner, outer)
    return known.otherwise(OTHER_STATUS)


def endpoint_label(route: Column, path: Column) -> Column:
    return F.coalesce(route, path)


def status_class(status: Column) -> Column:
    """2, 4, 5 … for 2xx, 4xx, 5xx."""
    return F.floor(status / 100).cast("int")


def seek_distance(new_offset: Column, old_offset: Column) -> Column:
    return new_offset - old_offset


def seek_direction(distance: Column) -> Column:
    return F.when(distance > 0, "forward").when(distance < 0, "back").otherwise("none")


# -- nested lists ----------------------------------------------------------------------


def list_add(items: Column, item: Column) -> Column:
    """Append an entry unless one with the same value is there."""
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def list_drop(items: Column, field: str, key) -> Column:
    """Remove the entries whose ``field`` equals ``key``."""
    return F.filter(items, lambda x: ~x[field].eqNullSafe(F.lit(key) if not isinstance(key, Column) else key))


# -- session snapshot ------------------------------------------------------------------

SNAPSHOT_SCHEMA = """
session_id string, user_id string, current_bitrate string, chunk_size int, status string,
current_chunk int, started_at string,
track struct<track_id: string, total_chunks: bigint, available_bitrates: array<string>, duration_ms: bigint>,
paused_at string, finished_at string
"""


def snapshot_json(snapshot: Column) -> Column:
    """Session snapshot as JSON; optional times are left out when null."""
    return F.to_json(snapshot)


def snapshot_from_json(text: Column) -> Column:
    return F.from_json(text, SNAPSHOT_SCHEMA)
