"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash inside their source, ranked, sorted by fractional rank
``(rank - 1/2) / rows of the source`` and cut into runs of equal length, so every shard holds
each source in the proportion of the whole mixture.

No rank is counted in one task. Rows of a source fall into cells of the hash, and rows of the
sorted mixture into cells of the fraction; both are even by construction, however large one
source is. A row's rank is the count of all earlier cells plus its place inside its own. The
number of cells follows the number of tasks and does not change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import settings, stage, tasks

HASH_BITS = 60
CELLS_PER_TASK = 4


def _cells(df: DataFrame) -> int:
    return 1 << (CELLS_PER_TASK * tasks(df.sparkSession) - 1).bit_length()


def _before(*partition: str):
    """Window frame of all earlier cells."""
    base = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return base.orderBy("_il_cell").rowsBetween(Window.unboundedPreceding, -1)


def shuffle_key(seed: int, *columns: str) -> Column:
    """A seeded 60-bit hash of some columns; equal rows get equal keys, nulls their own."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def interleave(rows: DataFrame, shards: int, key: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0) to every row.

    Shards differ by one row at most. A null source is a source of its own; null and repeated
    keys are ranked like others (ties by the rest of the row); equal rows are interchangeable;
    an empty table gives an empty result. Columns of ``rows`` named ``shard`` or ``slot`` are
    replaced; all others pass through. Pass only the columns that must travel: texts can be
    joined back on the key.
    """
    spark = settings(rows.sparkSession)
    rows = rows.drop("shard", "slot")
    carried = rows.columns
    cells = _cells(rows)
    ties = ["_il_key", F.col(key), F.xxhash64(*carried)]

    keyed = stage(
        rows.withColumn("_il_key", shuffle_key(seed, key))
        .withColumn("_il_source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")))
        .withColumn("_il_cell", F.shiftright("_il_key", HASH_BITS - (cells.bit_length() - 1))),
        "interleave-rows",
    )
    per_cell = keyed.groupBy("_il_source", "_il_cell").agg(F.count("*").alias("_il_n"))
    offsets = per_cell.select(
        "_il_source",
        "_il_cell",
        F.coalesce(F.sum("_il_n").over(_before("_il_source")), F.lit(0)).alias("_il_earlier"),
        F.sum("_il_n").over(Window.partitionBy("_il_source")).alias("_il_total"),
    )
    in_cell = Window.partitionBy("_il_source", "_il_cell").orderBy(*ties)
    ranked = (
        keyed.join(offsets, ["_il_source", "_il_cell"])
        .withColumn("_il_rank", F.col("_il_earlier") + F.row_number().over(in_cell))
        .withColumn("_il_fraction", (2 * F.col("_il_rank") - 1) / (2 * F.col("_il_total")))
        .withColumn("_il_cell", F.floor(F.col("_il_fraction") * cells))
        .select(*carried, "_il_key", "_il_fraction", "_il_cell")
    )
    ranked = stage(ranked, "interleave-ranks")

    per_cell = ranked.groupBy("_il_cell").agg(F.count("*").alias("_il_n"))
    # One row per cell of the fraction: as many as there are tasks, not as there are rows.
    offsets = per_cell.select(
        "_il_cell",
        F.coalesce(F.sum("_il_n").over(_before()), F.lit(0)).alias("_il_earlier"),
        F.sum("_il_n").over(Window.partitionBy(F.lit(0))).alias("_il_total"),
    )
    in_cell = Window.partitionBy("_il_cell").orderBy("_il_fraction", *ties)
    return (
        ranked.join(offsets, "_il_cell")
        .withColumn("_il_at", F.col("_il_earlier") + F.row_number().over(in_cell) - 1)
        .withColumn("shard", F.expr(f"(_il_at * {shards}L) div _il_total").cast("int"))
        .withColumn("slot", F.col("_il_at") - F.expr(f"(shard * _il_total + {shards - 1}L) div {shards}L"))
        .select(*carried, "shard", "slot")
    )
