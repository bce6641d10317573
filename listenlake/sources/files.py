"""Stored audio objects, request logs and relational tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.functions import scalars
from listenlake.sources.cdc import read_lines

REQUEST_SCHEMA = "ts timestamp, method string, route string, path string, status int, duration_s double"
# What a request must have to be counted.
NEEDED = ["ts", "method", "endpoint", "status", "duration_s"]


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """Audio objects below ``root``: path and size, contents not read.

    Spark's file sources leave out empty files, and the listing is held by the driver; use
    ``list_track_objects`` where either matters.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.mp3")
        .load(root)
        .select("path", "length")
    )


def list_track_objects(tracks: DataFrame, root: str) -> DataFrame:
    """Audio objects of the given tracks, empty ones too; each task lists its own tracks."""

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            found = []
            for track in batch["track_id"]:
                folder = fs.FileSelector(f"{base}/{track}", allow_not_found=True)
                found += [(f.path, f.size) for f in store.get_file_info(folder) if f.extension == "mp3"]
            yield pd.DataFrame(found, columns=["path", "length"])

    return tracks.select("track_id").mapInPandas(listing, "path string, length bigint")


def object_rows(objects: DataFrame) -> DataFrame:
    """Listing rows with the track and bitrate read from each path."""
    return objects.select(
        "path",
        "length",
        scalars.object_track(F.col("path")).alias("track_id"),
        scalars.object_bitrate(F.col("path")).alias("bitrate"),
    )


def normalise_requests(rows: DataFrame) -> DataFrame:
    """Request rows with the endpoint label: the route template, else the raw path."""
    return rows.withColumn("endpoint", scalars.endpoint_label(F.col("route"), F.col("path"))).drop("route", "path")


def parse_requests(lines: DataFrame) -> DataFrame:
    """Request rows of log lines (column ``value``), each with its ``problem`` or null.

    A line that is not a whole JSON object of the right types is unreadable; one that lacks what
    the metrics count by names the first field it lacks. Blank lines are no requests.
    """
    read = F.from_json("value", f"{REQUEST_SCHEMA}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(F.trim("value") != "").select("value", read.alias("_r")).select("value", "_r.*")
    rows = normalise_requests(rows)
    lacking = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in NEEDED]
    unreadable = F.when(F.col("_corrupt").isNotNull(), "unreadable")
    return rows.withColumn("problem", F.coalesce(unreadable, *lacking)).drop("_corrupt")


def read_request_log(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of the log files below a folder, those with a problem too."""
    return parse_requests(spark.read.text(folder))


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The requests that can be counted."""
    return read_request_log(spark, folder).where("problem IS NULL").drop("value", "problem")


def stream_request_log(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same lines as an unbounded source that takes new files as they come."""
    return parse_requests(read_lines(spark, folder, files_per_trigger))


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Snapshot of a relational table, read in parallel ranges of an integer key.

    Without bounds the database is asked for the key's smallest and largest value.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition_column is None:
        return reader.option("dbtable", table).load()
    if bounds is None:
        ends = f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}"
        row = reader.option("query", ends).load().first()
        bounds = (row[0] or 0, row[1] or 0)
        reader = spark.read.format("jdbc").options(url=url, **options)
    return reader.options(
        dbtable=table,
        partitionColumn=partition_column,
        lowerBound=str(bounds[0]),
        upperBound=str(bounds[1] + 1),
        numPartitions=str(partitions),
    ).load()
