"""One stream of user deletions, applied to every table that holds something of the user."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cascade:
    """Deletes users from all tables as their deletions come, and the playlists they own.

    ``tables`` hold rows by user (history, likes), by playlist (its tracks) or both (links). A
    deleted user's rows go, the user's playlists (``owners``) go, and with a playlist all its rows.
    A batch of deletions writes its users, the playlists that go with them and the rows each
    table loses to folders of its number, so a replay replaces them; a user deleted twice counts
    in the first batch only. Tables are not rewritten but read without what is deleted, so a row
    that comes after its user's deletion stays away too.
    """

    spark: SparkSession
    path: str
    tables: dict[str, Callable[[], DataFrame]]
    owners: Callable[[], DataFrame]
    user: str = "user_id"
    playlist: str = "playlist_id"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Writer for ``foreachBatch``; ``batch`` has the users to delete."""
        earlier = F.col("batch_id") < batch_id
        users = self._record("users", batch.select(self.user), self.user, batch_id)
        owned = self.owners().join(users, self.user, "left_semi").select(self.playlist)
        playlists = self._record("playlists", owned, self.playlist, batch_id)
        affected = None
        for name, table in self.tables.items():
            hit = table()
            held = [(c, gone) for c, gone in ((self.user, users), (self.playlist, playlists)) if c in hit.columns]
            if len(held) == 1:  # a batch's keys are no earlier one's
                hit = hit.join(held[0][1], held[0][0], "left_semi")
            else:
                for column, gone in held:
                    hit = hit.join(gone.withColumn(f"_{column}", F.lit(True)), column, "left")
                marked = F.col(f"_{self.user}").isNotNull() | F.col(f"_{self.playlist}").isNotNull()
                hit = self.left(hit.where(marked), earlier)
            counted = hit.agg(F.count(F.lit(1)).alias("affected")).select(F.lit(name).alias("table"), "affected")
            affected = counted if affected is None else affected.unionByName(counted)
        if affected is not None:
            affected.write.mode("overwrite").parquet(f"{self.path}/affected/batch_id={batch_id}")

    def _record(self, name: str, keys: DataFrame, column: str, batch_id: int) -> DataFrame:
        """Write a batch's distinct keys that no earlier batch has, and read them back."""
        keys = keys.where(F.col(column).isNotNull()).distinct()
        if self._exists(name):
            before = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch_id") < batch_id)
            keys = keys.join(before.select(column), column, "left_anti")
        keys.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")
        return self.spark.read.parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def left(self, rows: DataFrame, batches: Column | None = None) -> DataFrame:
        """Rows of a table, as it is now, without what all (or some) batches have deleted."""
        for column, name in ((self.user, "users"), (self.playlist, "playlists")):
            if column in rows.columns and self._exists(name):
                gone = self.spark.read.parquet(f"{self.path}/{name}")
                gone = gone if batches is None else gone.where(batches)
                rows = rows.join(gone.select(column), column, "left_anti")
        return rows

    def affected(self) -> DataFrame:
        """``batch_id, table, affected`` for every batch and table."""
        return self.spark.read.parquet(f"{self.path}/affected")
