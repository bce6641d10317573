"""Ordered scans over groups of any size.

``row_number``, ``lag``, ``lead``, running sums and "last value seen" are window functions,
and a window puts a whole group into one task, however large the group is. ``OrderedRows``
counts the rows of every group first. A group of more than MOST_ROWS is cut: its rows are
range-partitioned on (group, order) and each part is scanned on its own; what must cross a
border (a count, a sum, a last value, a state machine's transitions) is carried by a scan over
one summary row a part. All other groups are one part. Every scan is a window over (part,
group), so one shuffle serves a chain of scans, and only rows of cut groups meet a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.session import freeze

_CHUNK = "_chunk"
WHOLE = -1  # the part of all groups that are not cut
MOST_ROWS = 1 << 20  # rows of a group that is scanned whole


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column | None = None


def row_number() -> Scan:
    """1-based position of the row in its group."""
    return Scan("number")


def running_sum(value: Column) -> Scan:
    """Sum of ``value`` from the start of the group to this row."""
    return Scan("sum", value)


def last_seen(value: Column) -> Scan:
    """Last non-null ``value`` at or before this row."""
    return Scan("last", value)


def last_before(value: Column) -> Scan:
    """Last non-null ``value`` strictly before this row."""
    return Scan("before", value)


def previous(value: Column) -> Scan:
    """``value`` of the row before, null on the first row."""
    return Scan("previous", value)


def following(value: Column) -> Scan:
    """``value`` of the row after, null on the last row."""
    return Scan("following", value)


def order_columns(order: list[str]) -> list[Column]:
    """Sort keys from names; a leading minus sorts that key descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def _local(scan: Scan, window) -> Column:
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    if scan.kind == "number":
        return F.row_number().over(window).cast("long")
    if scan.kind == "sum":
        return F.sum(scan.value).over(so_far)
    if scan.kind == "last":
        return F.last(scan.value, ignorenulls=True).over(so_far)
    if scan.kind == "before":
        return F.last(scan.value, ignorenulls=True).over(earlier)
    if scan.kind == "previous":
        return F.lag(scan.value).over(window)
    return F.lead(scan.value).over(window)


@dataclass(frozen=True)
class OrderedRows:
    """Rows grouped by ``keys`` and ordered by ``order`` inside each group.

    ``order`` should identify a row inside its group, else ties fall as they come.
    """

    keys: list[str]
    order: list[str]
    rows: DataFrame
    cut: bool = False

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str]) -> OrderedRows:
        """Find the groups to cut and deal out their rows; this counts all rows by group.

        The rows of cut groups are written, as sampled borders must not change afterwards.
        """
        large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_ROWS)
        if large.isEmpty():
            return cls(keys, order, df.withColumn(_CHUNK, F.lit(WHOLE)))
        inside, outside = df, None
        if keys:
            large = freeze(large.select(*[F.col(k).alias(f"_g_{k}") for k in keys]), "cut-groups")
            same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
            inside, outside = df.join(large, same, "left_semi"), df.join(large, same, "left_anti")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = inside.repartitionByRange(parts, *[F.col(k) for k in keys], *order_columns(order))
        rows = freeze(dealt.withColumn(_CHUNK, F.spark_partition_id()), "ordered-rows")
        if outside is not None:
            rows = outside.withColumn(_CHUNK, F.lit(WHOLE)).unionByName(rows)
        return cls(keys, order, rows, True)

    def window(self):
        """The rows of one part of one group, in order."""
        return Window.partitionBy(_CHUNK, *self.keys).orderBy(*order_columns(self.order))

    def sort_order(self) -> list[Column]:
        """The order such a window leaves a partition in."""
        return [F.col(_CHUNK), *[F.col(k) for k in self.keys], *order_columns(self.order)]

    def carried(self, scanned: DataFrame, handed: list[Column], carry: Callable) -> DataFrame:
        """``scanned`` with what earlier or later parts of cut groups hand on.

        ``handed`` are aggregates over one part of one group; ``carry(pieces)`` makes columns of
        them over the window of a group's parts. Without cut groups those columns are null.
        """
        pieces = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        given = carry(pieces)
        if not self.cut:
            whole = scanned.limit(0).groupBy(_CHUNK, *self.keys).agg(*handed).select(*[c.alias(n) for n, c in given.items()])
            return scanned.withColumns({f.name: F.lit(None).cast(f.dataType) for f in whole.schema.fields})
        borders = scanned.where(F.col(_CHUNK) != WHOLE).groupBy(_CHUNK, *self.keys).agg(*handed)
        borders = borders.select(
            F.col(_CHUNK).alias("_c_chunk"),
            *[F.col(k).alias(f"_c_{k}") for k in self.keys],
            *[c.alias(n) for n, c in given.items()],
        )
        same = [F.col(_CHUNK) == F.col("_c_chunk")]
        same += [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in self.keys]
        return scanned.join(borders, same, "left").select(*scanned.columns, *given)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> OrderedRows:
        """Apply a row-wise change that keeps keys and order columns."""
        return replace(self, rows=change(self.rows))

    def frame(self) -> DataFrame:
        return self.rows.drop(_CHUNK)

    def add(self, **scans: Scan) -> OrderedRows:
        """Add one column per scan, all in the same pass."""
        return replace(self, rows=self._scanned(scans))

    def _scanned(self, scans: dict[str, Scan]) -> DataFrame:
        window = self.window()
        local = {f"_l_{n}": _local(s, window) for n, s in scans.items()}
        # What a part hands on: its running value at its last row, or a border row's value.
        handed = {
            f"_h_{n}": _local(last_seen(s.value), window) if s.kind == "before"
            else F.struct(s.value.alias("v")) if s.kind in ("previous", "following")
            else local[f"_l_{n}"]
            for n, s in scans.items()
        }
        ends = {"_first": F.row_number().over(window) == 1, "_last": F.lead(F.lit(1)).over(window).isNull()}
        scanned = self.rows.withColumns({**local, **handed, **ends})
        at_border = [
            F.max(F.when(F.col("_first" if s.kind == "following" else "_last"), F.col(f"_h_{n}"))).alias(f"_h_{n}")
            for n, s in scans.items()
        ]

        def carry(pieces) -> dict[str, Column]:
            earlier = pieces.rowsBetween(Window.unboundedPreceding, -1)
            return {
                f"_c_{n}": F.sum(f"_h_{n}").over(earlier) if s.kind in ("number", "sum")
                else F.last(f"_h_{n}", ignorenulls=True).over(earlier) if s.kind in ("last", "before")
                else F.lag(f"_h_{n}").over(pieces) if s.kind == "previous"
                else F.lead(f"_h_{n}").over(pieces)
                for n, s in scans.items()
            }

        joined = self.carried(scanned, at_border, carry)
        results = {}
        for n, s in scans.items():
            here, carry_over = F.col(f"_l_{n}"), F.col(f"_c_{n}")
            if s.kind == "number":
                results[n] = here + F.coalesce(carry_over, F.lit(0))
            elif s.kind == "sum":
                results[n] = F.when(here.isNull(), carry_over).otherwise(here + F.coalesce(carry_over, F.lit(0)))
            elif s.kind in ("last", "before"):
                results[n] = F.coalesce(here, carry_over)
            elif s.kind == "previous":
                results[n] = F.when(F.col("_first"), carry_over["v"]).otherwise(here)
            else:
                results[n] = F.when(F.col("_last"), carry_over["v"]).otherwise(here)
        return joined.select(*self.rows.columns, *[c.alias(n) for n, c in results.items()])
