"""Rows too late for a day that is closed: kept beside it, and merged in by a correction job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LateSplit:
    """Splits every micro-batch by the watermark that held when it began.

    The watermark is the newest time of all earlier batches less ``lateness`` seconds, as a
    stateful step would have it; it is read from what the earlier batches wrote, so a replayed
    batch is split the same way and overwrites its own folders. Rows behind it, and rows without
    a time, go to the late table; the others are counted by day at once.
    """

    spark: SparkSession
    path: str
    ts: str
    lateness: int

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Writer for ``foreachBatch``. The newest time is written last: it commits the batch."""
        ts = F.col(self.ts)
        closed = self._watermark(batch_id)
        in_time = ts.isNotNull() if closed is None else ts.isNotNull() & (ts > F.lit(closed))
        late = batch.where(~in_time)
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch_id={batch_id}")
        self._days(batch.where(in_time)).write.mode("overwrite").parquet(f"{self.path}/days/batch_id={batch_id}")
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{self.path}/newest/batch_id={batch_id}")

    def _watermark(self, batch_id: int):
        if batch_id == 0 or not self._exists("newest"):
            return None
        earlier = self.spark.read.parquet(f"{self.path}/newest").where(F.col("batch_id") < batch_id)
        return earlier.agg(F.max("newest") - F.make_dt_interval(secs=F.lit(self.lateness))).first()[0]

    def _days(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col(self.ts).cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n"))

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def live_days(self) -> DataFrame:
        """Rows a day as counted when they came."""
        return self.spark.read.parquet(f"{self.path}/days").groupBy("period").agg(F.sum("n").alias("n"))

    def late_rows(self) -> DataFrame:
        """All rows that came too late, whole, with their batch."""
        return self.spark.read.parquet(f"{self.path}/late")

    def correct(self, up_to: int) -> None:
        """Count the late rows of batches up to ``up_to``; a second run gives the same files."""
        counted = self._days(self.late_rows().where(F.col("batch_id") <= up_to).where(F.col(self.ts).isNotNull()))
        counted.write.mode("overwrite").parquet(f"{self.path}/corrections/up_to={up_to}")

    def corrected_days(self) -> DataFrame:
        """Live days with the corrections of the latest run."""
        live = self.live_days()
        if not self._exists("corrections"):
            return live
        runs = self.spark.read.parquet(f"{self.path}/corrections")
        latest = runs.agg(F.max("up_to")).first()[0]
        both = live.unionByName(runs.where(F.col("up_to") == F.lit(latest)).select("period", "n"))
        return both.groupBy("period").agg(F.sum("n").alias("n"))
