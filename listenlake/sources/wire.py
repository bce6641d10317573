"""Event messages on the wire: a type header beside a protobuf body.

Bodies are decoded in ``mapInPandas`` (the protobuf connector is not on the classpath);
everything around that is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "event-type"

# Field numbers and types of the event messages.
MESSAGES = {
    "SessionStarted": {
        "session_id": (1, "string"), "user_id": (2, "string"), "track_id": (3, "string"),
        "bitrate": (4, "string"), "timestamp": (5, "time"),
    },
    "ChunksAckEvent": {"session_id": (1, "string"), "acked_chunk_count": (2, "int32"), "timestamp": (3, "time")},
    "BitrateChangedEvent": {"session_id": (1, "string"), "new_bitrate": (2, "int32"), "timestamp": (3, "time")},
    "OffsetChangedEvent": {
        "session_id": (1, "string"), "new_chunk_offset": (2, "int32"), "old_chunk_offset": (3, "int32"),
        "timestamp": (4, "time"),
    },
    "SessionPaused": {"session_id": (1, "string"), "timestamp": (2, "time")},
    "SessionResumed": {"session_id": (1, "string"), "timestamp": (2, "time")},
    "SessionStopped": {"session_id": (1, "string"), "total_chunks_sent": (2, "int32"), "timestamp": (3, "time")},
    "UserRegistered": {"user_id": (1, "string"), "timestamp": (5, "time")},
    "TrackAddedToPlaylist": {
        "playlist_id": (1, "int32"), "track_id": (2, "int32"), "user_id": (3, "int32"), "timestamp": (5, "time"),
    },
    "UserDeleted": {"user_id": (1, "string")},
    "SessionHistory": {
        "user_id": (1, "int64"), "track_id": (2, "int64"), "total_chunks_sent": (3, "int64"),
        "total_chunks": (4, "int64"), "timestamp": (5, "time"),
    },
}
# The registering service numbers its time field differently from the analytics consumer.
USER_SERVICE_MESSAGES = {"UserRegistered": {"user_id": (1, "string"), "timestamp": (2, "time")}}

SESSION_TYPES = [
    "SessionStarted", "ChunksAckEvent", "BitrateChangedEvent", "OffsetChangedEvent",
    "SessionPaused", "SessionResumed", "SessionStopped",
]

TEXT_FIELDS = ["session_id", "user_id", "track_id", "bitrate"]
INT_FIELDS = [
    "new_bitrate", "acked_chunk_count", "total_chunks_sent", "total_chunks",
    "new_chunk_offset", "old_chunk_offset", "playlist_id",
]
_DECODED = (
    ", ".join(f"{f} string" for f in TEXT_FIELDS)
    + ", "
    + ", ".join(f"{f} bigint" for f in INT_FIELDS)
    + ", seconds bigint, nanos bigint, problem string"
)


def _message_classes(messages: dict) -> dict:
    """Message classes built from the field table, on the worker."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    types = descriptor_pb2.FieldDescriptorProto
    codes = {"string": types.TYPE_STRING, "int32": types.TYPE_INT32, "int64": types.TYPE_INT64, "time": types.TYPE_MESSAGE}
    file = descriptor_pb2.FileDescriptorProto(name="events.proto", package="wire", syntax="proto3")
    stamp = file.message_type.add(name="Stamp")
    stamp.field.add(name="seconds", number=1, type=types.TYPE_INT64, label=types.LABEL_OPTIONAL)
    stamp.field.add(name="nanos", number=2, type=types.TYPE_INT32, label=types.LABEL_OPTIONAL)
    for name, fields in messages.items():
        message = file.message_type.add(name=name)
        for field, (number, kind) in fields.items():
            extra = {"type_name": ".wire.Stamp"} if kind == "time" else {}
            message.field.add(name=field, number=number, type=codes[kind], label=types.LABEL_OPTIONAL, **extra)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return {n: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"wire.{n}")) for n in messages}


def _decode_one(message, fields: dict, body: bytes) -> dict:
    message.ParseFromString(bytes(body))
    row = {}
    for field, (_, kind) in fields.items():
        if kind == "time":
            if message.HasField(field):
                row["seconds"], row["nanos"] = message.timestamp.seconds, message.timestamp.nanos
        elif field in TEXT_FIELDS:
            row[field] = str(getattr(message, field))
        else:
            row[field] = int(getattr(message, field))
    return row


def with_type(messages: DataFrame) -> DataFrame:
    """Add ``event_type`` from the header; null where the header is missing or empty."""
    entry = F.filter("headers", lambda h: h["key"] == HEADER)
    value = F.get(entry, F.lit(0))["value"].cast("string")
    return messages.withColumn("event_type", F.nullif(value, F.lit("")))


def decode(messages: DataFrame, overrides: dict | None = None) -> DataFrame:
    """One sparse row per message, routed on its type header.

    ``messages`` has key, value, headers and the record time ``timestamp``; other columns
    are kept. ``problem`` names why a message could not be read. A message without its own
    time takes the record time. ``overrides`` replaces field tables for a given source.
    """
    tables = {**MESSAGES, **(overrides or {})}
    kept = [f for f in with_type(messages).schema.fields if f.name not in ("value", "headers", "timestamp")]
    columns = [f.name for f in kept]
    routed = with_type(messages).select(*columns, F.col("timestamp").alias("record_time"), F.col("value").alias("_body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", record_time timestamp, " + _DECODED

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = _message_classes(tables)
        for batch in batches:
            rows = []
            for event_type, body in zip(batch["event_type"], batch["_body"]):
                if event_type is None:
                    rows.append({"problem": "missing header"})
                elif event_type not in classes:
                    rows.append({"problem": "unknown type"})
                else:
                    try:
                        rows.append(_decode_one(classes[event_type](), tables[event_type], body))
                    except Exception:  # any parse failure marks this message only
                        rows.append({"problem": "bad payload"})
            read_columns = TEXT_FIELDS + INT_FIELDS + ["seconds", "nanos", "problem"]
            decoded = pd.DataFrame(rows, columns=read_columns, index=batch.index, dtype=object)
            for column in INT_FIELDS + ["seconds", "nanos"]:
                decoded[column] = decoded[column].astype("Int64")
            yield pd.concat([batch.drop(columns="_body"), decoded], axis=1)

    own_time = F.timestamp_micros(F.col("seconds") * 1_000_000 + F.floor(F.col("nanos") / 1000))
    return (
        routed.mapInPandas(read, schema)
        .withColumn("timestamp", F.coalesce(own_time, "record_time"))
        .drop("seconds", "nanos", "record_time")
    )


def encode(events: DataFrame) -> DataFrame:
    """Messages (key, value, headers) for typed event rows; the inverse of ``decode``."""
    fields = [c for c in TEXT_FIELDS + INT_FIELDS if c in events.columns]
    rows = events.select("event_type", *fields, F.unix_micros("timestamp").alias("_micros"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = _message_classes(MESSAGES)
        for batch in batches:
            bodies = []
            for row in batch.to_dict("records"):
                table = MESSAGES[row["event_type"]]
                message = classes[row["event_type"]]()
                for field, (_, kind) in table.items():
                    if kind == "time":
                        message.timestamp.seconds, micros = divmod(int(row["_micros"]), 1_000_000)
                        message.timestamp.nanos = micros * 1000
                    elif row.get(field) is not None and not pd.isna(row[field]):
                        value = row[field]
                        if isinstance(value, float):
                            value = int(value)
                        setattr(message, field, str(value) if kind == "string" else int(value))
                bodies.append(message.SerializeToString())
            yield pd.DataFrame({"event_type": batch["event_type"], "key": batch.get("session_id"), "value": bodies})

    encoded = rows.mapInPandas(write, "event_type string, key string, value binary")
    header = F.struct(F.lit(HEADER).alias("key"), F.col("event_type").cast("binary").alias("value"))
    return encoded.select(F.col("key").cast("binary").alias("key"), "value", F.array(header).alias("headers"))


def typed_union(decoded: DataFrame, types: list[str] = SESSION_TYPES) -> DataFrame:
    """The sparse session table: per type, only that type's columns; the rest stay null."""
    wanted = [f for f in TEXT_FIELDS + INT_FIELDS if any(f in MESSAGES[t] for t in types)]
    holders = {f: [t for t in types if f in MESSAGES[t]] for f in wanted}
    return decoded.where(F.col("problem").isNull() & F.col("event_type").isin(types)).select(
        "event_type",
        *[F.when(F.col("event_type").isin(holders[f]), F.col(f)).alias(f) for f in wanted],
        "timestamp",
    )
