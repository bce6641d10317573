"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on (UTC) and those skewed joins need."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it.

    Only a session on a local master may do without: driver and executors are then one process
    and a temporary folder is seen by both. Anywhere else that would lose data, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return _local_dir(spark.sparkContext.master, spark.sparkContext.setCheckpointDir, spark.sparkContext.getCheckpointDir)


def _local_dir(master: str, set_dir: Callable[[str], None], get_dir: Callable[[], str]) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all of {master} can see")
    set_dir(tempfile.mkdtemp(prefix="listenlake-"))
    return get_dir().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application so it can be cleared."""
    return f"{shared_dir(spark)}/listenlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where rows must not be computed again differently (for example after a sampled
    range partitioning) and to cut lineage: a lost executor re-reads files.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fine_pieces(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` into four times as many pieces as a shuffle makes, which are not merged again.

    For groups that hardly repeat: grouped where they are read, or in merged pieces, every task's
    hash map would hold nearly all its rows.
    """
    pieces = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(pieces, *keys)


def drop_staged(spark: SparkSession, path: str | None = None) -> None:
    """Remove one staged table, or all that this application has staged, once nothing reads them."""
    root = f"{shared_dir(spark)}/listenlake/{spark.sparkContext.applicationId}"
    path = path or root
    if not path.startswith(root):
        raise ValueError(f"{path} was not staged by this application")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
