"""Helpers the operators share: staged tables and Arrow batches of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from listenlake.session import prepare, staging_path

ROWS_PER_BATCH = 512  # rows of one Arrow batch sent to a Python worker


def settings(spark: SparkSession) -> SparkSession:
    """UTC, adaptive execution, and small Arrow batches so that long texts stay bounded."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the cluster's shared folder and read it back.

    This fixes values that a second run could choose differently (task numbers, range
    borders) and cuts the lineage: after a lost executor the files are read again.
    """
    path = staging_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``most_bytes`` of one column."""
    sizes = [len(v) if v is not None else 0 for v in (x.as_buffer() for x in batch.column(column))]
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)
