"""Starting streams: append pipelines, idempotent batch sinks, lateness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from listenlake.operators.sinks import SORT_KEYS
from listenlake.sources import cdc
from listenlake.streaming.capture import CaptureTable


def _trigger(writer, once: bool):
    """Process what is there and stop, or run on as data comes."""
    return writer.trigger(availableNow=True) if once else writer


def append_files(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append rows to files; the file sink's own log makes each batch count once."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(writer, once).start()


def each_batch(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    once: bool = False,
) -> StreamingQuery:
    """Hand every micro-batch to ``write``.

    An error in ``write`` stops the query, and the restarted query replays the batch under
    the same number; ``write`` must make that harmless (see ``batch_folder``).
    """
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(writer, once).start()


def batch_folder(path: str, by: list[str] = ()) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to a folder of its number, replacing a half-written one.

    Below it the columns ``by`` are folders, so that readers of one value read no other's files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch_id={batch_id}")

    return write


@dataclass(frozen=True)
class CdcTable:
    name: str
    row: str


CDC_TABLES = [CdcTable(name, row) for name, row in cdc.ROWS.items()]


def run_cdc(
    sources: dict[str, DataFrame], out: str, checkpoints: str, once: bool = False
) -> dict[str, StreamingQuery]:
    """One append pipeline per captured table, each with its own checkpoint."""
    return {
        table.name: append_files(
            cdc.parse(sources[table.name], table.row), f"{out}/{table.name}", f"{checkpoints}/{table.name}", once
        )
        for table in CDC_TABLES
        if table.name in sources
    }


def capture_tables(spark: SparkSession, out: str) -> dict[str, CaptureTable]:
    """The captured tables below a folder, each sorted by its own key."""
    return {table.name: CaptureTable(spark, f"{out}/{table.name}", SORT_KEYS[table.name]) for table in CDC_TABLES}


def run_capture(
    spark: SparkSession, sources: dict[str, DataFrame], out: str, checkpoints: str,
    merge_every: int | None = None, once: bool = False,
) -> dict[str, StreamingQuery]:
    """Change lines of each table, parsed, into its defaulted table by day; see ``capture_tables``."""
    tables = capture_tables(spark, out)
    return {
        table.name: each_batch(
            cdc.parse(sources[table.name], table.row), tables[table.name].writer(merge_every),
            f"{checkpoints}/{table.name}", once=once,
        )
        for table in CDC_TABLES
        if table.name in sources
    }


def wait_for_any(spark: SparkSession) -> None:
    """Block until one of the session's queries ends."""
    spark.streams.awaitAnyTermination()


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful steps drop as too late, over all batches of every query.

    Add it to ``spark.streams`` before the queries start; progress reports kept by a query
    itself are only its most recent ones.
    """

    def __init__(self):
        self.by_query: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.by_query[str(event.id)] = 0

    def onQueryProgress(self, event):
        late = sum(step.numRowsDroppedByWatermark for step in event.progress.stateOperators)
        self.by_query[str(event.progress.id)] = self.by_query.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def of(self, query: StreamingQuery) -> int:
        """Late rows of a query so far."""
        return self.by_query.get(str(query.id), 0)
