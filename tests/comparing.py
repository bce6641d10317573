"""Compare a Spark result with a SQL result: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int,)):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    return type(value).__name__


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _typed(value):
    return (_kind(value), _plain(value))


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_typed(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql: str):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, Counter(tuple(_typed(r[i]) for i in at) for r in cursor.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    spark_names, spark_rows = rows_of_spark(df)
    sql_names, sql_rows = rows_of_sql(con, sql)
    if spark_names != sql_names:
        return f"columns {spark_names} against {sql_names}"
    if spark_rows != sql_rows:
        extra, lacking = spark_rows - sql_rows, sql_rows - spark_rows
        return (
            f"{sum(spark_rows.values())} rows against {sum(sql_rows.values())}; "
            f"{sum(extra.values())} only in Spark e.g. {list(extra)[:2]}; "
            f"{sum(lacking.values())} only in SQL e.g. {list(lacking)[:2]}"
        )
    return None


# Spark type names and the SQL names of the same types.
SAME_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, con, sql: str) -> list[str]:
    """Columns whose declared types differ between the two results."""
    declared = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name}: {kind} against {declared[name]}" for name, kind in df.dtypes if SAME_TYPES.get(kind) != declared[name]
    ]
