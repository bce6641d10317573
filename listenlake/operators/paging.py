"""Pages: one ordered slice, or a slice of every key at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.functions.rules import check_limit, check_page
from listenlake.operators import ordered
from listenlake.operators.ordered import OrderedRows, order_columns
from listenlake.session import freeze


def page(df: DataFrame, order: list[str], page_no: int = 1, page_size: int = 50) -> DataFrame:
    """Page ``page_no`` of ``df`` in a stated order."""
    check_page(page_no, page_size)
    return df.orderBy(*order_columns(order)).offset((page_no - 1) * page_size).limit(page_size)


def piece(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after skipping ``offset``, in a stated order."""
    check_limit(limit, offset)
    return df.orderBy(*order_columns(order)).offset(offset).limit(limit)


def first_of_each(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first page of ``n`` rows for every key."""
    check_limit(n)
    return top_of_each(df, keys, order, n)


def top_of_each(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every key, with their rank.

    Spark keeps n rows per key and task before the shuffle (WindowGroupLimit), so a key with
    most of the rows sends only n per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order_columns(order))
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def with_total(page_df: DataFrame, matches: DataFrame) -> DataFrame:
    """The page with the number of all matches beside each row."""
    return page_df.withColumn("total", matches.agg(F.count(F.lit(1))).scalar())


def _beyond(order: str, value, inclusive: bool) -> Column:
    """Rows whose value of one sort key comes after ``value``; null is first ascending and last descending."""
    column = F.col(order.removeprefix("-"))
    if order.startswith("-"):
        if value is None:
            return column.isNull() if inclusive else F.lit(False)
        return (column <= F.lit(value) if inclusive else column < F.lit(value)) | column.isNull()
    if value is None:
        return F.lit(True) if inclusive else column.isNotNull()
    return column >= F.lit(value) if inclusive else column > F.lit(value)


def after(order: list[str], cursor: Mapping, inclusive: bool = False) -> Column:
    """Whether a row comes after the cursor (or at it) in a stated order.

    ``cursor`` has the cursor row's value of every sort key. The first key's range stands by
    itself, so that it reaches the scan.
    """
    values = [cursor[o.removeprefix("-")] for o in order]
    found = F.lit(inclusive)
    for o, value in reversed(list(zip(order, values, strict=True))):
        same = F.col(o.removeprefix("-")).eqNullSafe(F.lit(value))
        found = _beyond(o, value, False) | (same & found)
    return _beyond(order[0], values[0], True) & found


def next_page(df: DataFrame, order: list[str], cursor: Mapping | None, page_size: int) -> DataFrame:
    """The ``page_size`` rows after the cursor row, or the first ones without a cursor.

    ``order`` has to tell rows apart. Nothing before the cursor is sorted or skipped: what is
    left after the range is cut to a page in every task.
    """
    check_limit(page_size)
    rows = df if cursor is None else df.where(after(order, cursor))
    return rows.orderBy(*order_columns(order)).limit(page_size)


@dataclass(frozen=True)
class PageStarts:
    """The first row of every page of a table, so that any page is a range from its start.

    One ordered scan finds them all; there is one small row a page. They hold for the table as
    it was then: rows added later make the pages they fall into longer only when asked for by
    number, as a page is ``page_size`` rows from its start.
    """

    rows: DataFrame
    order: list[str]
    page_size: int
    starts: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, order: list[str], page_size: int) -> PageStarts:
        check_limit(page_size)
        names = [o.removeprefix("-") for o in order]
        numbered = OrderedRows.of(rows.select(*names), [], order).add(_n=ordered.row_number()).frame()
        first = numbered.where((F.col("_n") - 1) % page_size == 0)
        page = F.expr(f"(_n - 1) div {page_size} + 1").alias("page")
        return cls(rows, order, page_size, freeze(first.select(page, *names), "page-starts"))

    def page(self, number: int) -> DataFrame:
        """Page ``number``; empty beyond the last."""
        check_page(number, self.page_size)
        start = self.starts.where(F.col("page") == number).first()
        if start is None:
            return self.rows.limit(0)
        here = self.rows.where(after(self.order, start.asDict(), inclusive=True))
        return here.orderBy(*order_columns(self.order)).limit(self.page_size)
