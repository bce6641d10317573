"""Captured events straight into a defaulted, sorted table by day that merges its small files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.operators.sinks import DAY, to_seconds, with_sink_defaults, write_events

MANIFEST = f"{DAY} date, version long"


@dataclass(frozen=True)
class CaptureTable:
    """Events by day, sorted inside files, written batch by batch.

    Each batch goes to a folder of its number, so a replayed batch replaces itself. ``merge``
    rewrites the days that batches have touched into few sorted files and then writes a
    manifest: which version holds each day, and up to which batch all is merged. The manifest
    is the switch: readers take the newest complete one, and until it is there they see the old
    files. A merge that dies leaves files no manifest names. Days without new rows stay as they are.
    Rows without a time are a day of their own, the null one.
    """

    spark: SparkSession
    path: str
    sort_key: list[str]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Writer for ``foreachBatch``: defaults, whole seconds, day and sort key."""
        rows = to_seconds(with_sink_defaults(batch))
        write_events(rows, f"{self.path}/batches/batch_id={batch_id}", self.sort_key, "overwrite")

    def read(self) -> DataFrame:
        """All rows, each once, with their day; filters on the day and the sort key prune files."""
        version, up_to = self._state()
        new = self._batches().where(F.col("batch_id") > up_to).drop("batch_id")
        if version is None:
            return new
        return self._merged(version).unionByName(new)

    def writer(self, merge_every: int | None = None) -> Callable[[DataFrame, int], None]:
        """``write`` for ``foreachBatch`` that also merges after every so many batches."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.write(batch, batch_id)
            if merge_every and (batch_id + 1) % merge_every == 0:
                self.merge(batch_id)

        return write

    def merge(self, up_to: int) -> None:
        """Merge all batches up to ``up_to``, which must be complete."""
        version, done = self._state()
        new = self._batches().where((F.col("batch_id") > done) & (F.col("batch_id") <= up_to)).drop("batch_id")
        # A version is named after the batch it ends with, so a repeated merge replaces its own files.
        touched = new.select(F.col(DAY).alias("_day")).distinct()
        same = F.col(DAY).eqNullSafe(F.col("_day"))
        rows, days = new, touched.withColumnRenamed("_day", DAY).withColumn("version", F.lit(up_to).cast("long"))
        if version is not None:
            rows = self._merged(version).join(touched, same, "left_semi").unionByName(new)
            days = days.unionByName(self._manifest(version).join(touched, same, "left_anti"))
        if up_to <= done:
            return
        write_events(rows.drop(DAY), f"{self.path}/merged/version={up_to}", self.sort_key, "overwrite")
        days.write.mode("overwrite").parquet(f"{self.path}/manifest/upto={up_to}")

    def _batches(self) -> DataFrame:
        return self._stored("batches")

    def _stored(self, folder: str) -> DataFrame:
        # The day is read from folder names; where all are null, they do not tell that it is a date.
        return self.spark.read.parquet(f"{self.path}/{folder}").withColumn(DAY, F.col(DAY).cast("date"))

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/upto={version}")

    def _merged(self, version: int) -> DataFrame:
        """Each day's rows from the version that holds it; versions and days are folders, so others are not read."""
        days = self._manifest(version).withColumnRenamed("version", "_version").withColumnRenamed(DAY, "_day")
        stored = self._stored("merged")
        held = (F.col("version") == F.col("_version")) & F.col(DAY).eqNullSafe(F.col("_day"))
        return stored.join(days, held, "left_semi").drop("version")

    def _state(self) -> tuple[int | None, int]:
        """The newest manifest, and the last batch it covers (-1: none)."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return None, -1
        names = [s.getPath() for s in files.listStatus(root)]
        whole = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        version = max((int(p.getName().split("=")[1]) for p in whole), default=None)
        return version, -1 if version is None else version
