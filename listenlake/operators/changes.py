"""Change logs: current state and field-level audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Audit rows are made from updates; ``changes`` has before, after, op and a log position.


def current_state(changes: DataFrame, key: str, position: str) -> DataFrame:
    """Last image of each key; keys whose last change is a delete are gone.

    ``max_by`` combines before the shuffle, so a key changed very often sends one row per
    task.
    """
    keyed = changes.withColumn("_key", F.coalesce(F.col(f"after.{key}"), F.col(f"before.{key}"))).where(
        F.col("_key").isNotNull()
    )
    last = keyed.groupBy("_key").agg(F.max_by(F.struct("op", "after"), position).alias("last"))
    return last.where(F.col("last.op") != "d").select("last.after.*")


def audit_log(changes: DataFrame, key: str, position: str, fields: list[str]) -> DataFrame:
    """One row per updated field: key, field, old and new value as text, log position."""

    def entry(field: str):
        old, new = F.col(f"before.{field}"), F.col(f"after.{field}")
        return F.when(
            ~old.eqNullSafe(new),
            F.struct(
                F.lit(field).alias("field_name"),
                old.cast("string").alias("old_value"),
                new.cast("string").alias("new_value"),
            ),
        )

    updates = changes.where("op = 'u'")
    return updates.select(
        F.col(f"after.{key}").alias(key),
        F.col(position),
        F.inline(F.array_compact(F.array(*[entry(f) for f in fields]))),
    )


@dataclass(frozen=True)
class ChangeTable:
    """Current state of a change log that arrives in batches, in any order and perhaps again.

    A batch keeps for each key the position of its last delete and, for each column, the last
    position that set it and the value. Both are maxima, so batches combine in any order,
    a replayed batch (which replaces its folder) or a row delivered twice changes nothing, and a
    key changed very often sends one row a task. An image may hold some columns only: the
    others keep their values; a column set to null is null. What is older than a key's last
    delete counts for nothing, so a key inserted again starts empty.
    """

    spark: SparkSession
    path: str
    key: str
    columns: list[str]

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """``changes`` has ``op``, ``position``, the key, the columns and ``present`` (names that the image holds)."""
        self._combined(
            changes.where(F.col(self.key).isNotNull()).select(
                self.key,
                F.when(F.col("op") == "d", F.col("position")).alias("_gone"),
                F.when(F.col("op") != "d", F.col("position")).alias("_set"),
                *[self._versioned(c).alias(c) for c in self.columns],
            )
        ).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def _versioned(self, column: str) -> Column:
        held = (F.col("op") != "d") & F.array_contains("present", column)
        return F.when(held, F.struct(F.col("position").alias("at"), F.col(column).alias("value")))

    def _combined(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(*[F.max(c).alias(c) for c in ("_gone", "_set", *self.columns)])

    def read(self) -> DataFrame:
        """One row for every key that is not deleted."""
        state = self._combined(self.spark.read.parquet(self.path).drop("batch_id"))
        gone = F.coalesce("_gone", F.lit(-1))
        return state.where(F.col("_set") > gone).select(
            self.key, *[F.when(F.col(c)["at"] > gone, F.col(c)["value"]).alias(c) for c in self.columns]
        )
