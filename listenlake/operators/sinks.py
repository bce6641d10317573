"""Writing: typed defaults, sorted layout, keyed tables, topics, relational appends."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlake.functions.scalars import or_default

# Sort key of each event table.
SORT_KEYS = {
    "session_events": ["session_id", "timestamp"],
    "playlist_events": ["playlist_id", "timestamp"],
    "users_events": ["user_id", "timestamp"],
}
DAY = "event_date"


def with_sink_defaults(df: DataFrame) -> DataFrame:
    """Null text becomes '' and null numbers 0, as the column store declares."""

    def filled(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.StringType):
            return or_default(F.col(field.name), "").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.LongType)):
            return or_default(F.col(field.name), 0).alias(field.name)
        return F.col(field.name)

    return df.select(*[filled(f) for f in df.schema.fields])


def to_seconds(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Drop fractions of a second, the precision of the column store."""
    return df.withColumn(ts, F.date_trunc("second", ts))


def write_events(df: DataFrame, path: str, sort_key: list[str], mode: str = "append") -> None:
    """Write events by day, sorted inside files so row-group statistics can prune.

    Range partitioning on (day, sort key) gives tasks of like size even when one day or one
    session holds much of the data, and each task writes few days.
    """
    dated = df.withColumn(DAY, F.col("timestamp").cast("date"))
    keys = [DAY, *sort_key]
    dated.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy(DAY).parquet(path)


def split_failures(df: DataFrame, key: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents that can be written, and those that cannot with what they lack."""
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in [key, *required]]))
    marked = df.withColumn("lacking", lacking)
    return marked.where(F.size("lacking") == 0).drop("lacking"), marked.where(F.size("lacking") > 0)


#: The writer name of compacted rows; it holds a character no other writer's name may have.
BASE = "~base"


@dataclass(frozen=True)
class KeyedTable:
    """A table with one current row per key, kept as appended batches of changes.

    A batch goes to its own folder and overwrites it when replayed, so a batch written twice
    counts once; ``writer`` keeps the batches of several queries apart. Reading takes one row
    per key with one partial aggregation. With a ``version`` column the largest version counts;
    at equal versions a deletion wins, then the later batch, then the writer's name. Without
    one, the later batch counts, then a deletion, then the writer's name, so batches of
    several writers are only comparable where the caller numbers them together.

    ``schema`` (of the rows) lets a table be read before its first batch is written. ``compact``
    writes the current rows and the deletions as a new table, older than any batch to come;
    the old one stays whole for readers until the caller switches over.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    version: str | None = None
    schema: str | None = None

    def upsert(self, df: DataFrame, batch_id: int, writer: str = "main") -> None:
        """Write one batch; it holds at most one row per key."""
        self.change(df, F.lit(False), batch_id, writer)

    def change(self, df: DataFrame, deleted: Column, batch_id: int, writer: str = "main") -> None:
        """Write one batch in which rows matching ``deleted`` remove their key."""
        if "~" in writer or "/" in writer:
            raise ValueError(f"a writer may not be called {writer!r}")
        self._write(df.withColumn("_deleted", F.coalesce(deleted, F.lit(False))), batch_id, writer)

    def _write(self, marked: DataFrame, batch_id: int, writer: str) -> None:
        marked.write.mode("overwrite").parquet(f"{self.path}/writer={writer}/batch_id={batch_id}")

    def _stored(self) -> DataFrame:
        if self.schema is not None and not self._exists():
            rows = self.spark.createDataFrame([], self.schema)
            return rows.withColumns(
                {"_deleted": F.lit(False), "writer": F.lit(""), "batch_id": F.lit(0).cast("long")}
            )
        stored = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/writer=*")
        return stored.withColumn("writer", F.col("writer").cast("string"))

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _newest(self) -> DataFrame:
        """The row that counts of each key, deletions included."""
        stored = self._stored()
        columns = [c for c in stored.columns if c not in (*self.keys, "_deleted", "writer", "batch_id")]
        batch = F.when(F.col("writer") == BASE, -1).otherwise(F.col("batch_id").cast("long"))
        if self.version:
            age = [F.col(self.version), F.col("_deleted"), batch, F.col("writer")]
        else:
            age = [batch, F.col("_deleted"), F.col("writer")]
        age = [c.alias(f"a{i}") for i, c in enumerate(age)]
        newest = stored.groupBy(*self.keys).agg(F.max_by(F.struct("_deleted", *columns), F.struct(*age)).alias("_row"))
        return newest.select(*self.keys, *[F.col(f"_row.{c}") for c in columns], "_row._deleted")

    def read(self) -> DataFrame:
        """Current rows."""
        return self._newest().where(~F.col("_deleted")).drop("_deleted")

    def compact(self, path: str) -> KeyedTable:
        """A new table at ``path`` that reads the same, now and after further changes to it."""
        compacted = replace(self, path=path)
        compacted._write(self._newest(), 0, BASE)
        return compacted


def to_topics(df: DataFrame, topics: list[str], key: str, event_type: Column, value: Column) -> DataFrame:
    """Messages to publish: key, type header and body, one copy per topic."""
    header = F.struct(F.lit("event-type").alias("key"), event_type.cast("binary").alias("value"))
    return df.select(
        F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"),
        F.col(key).cast("string").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.array(header).alias("headers"),
    )


def publish(messages: DataFrame, servers: str) -> None:
    """Send messages to their topics (needs the Kafka connector on the classpath)."""
    writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("includeHeaders", "true").save()


def append_rows(df: DataFrame, url: str, table: str, batch_rows: int = 10_000, **options: str) -> None:
    """Insert rows into a relational table, each task over its own connection."""
    df.write.format("jdbc").options(
        url=url, dbtable=table, batchsize=str(batch_rows), **options
    ).mode("append").save()
