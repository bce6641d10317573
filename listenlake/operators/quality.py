"""Data-quality checks: broken rules, duplicates, missing references, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.functions.rules import failed_rules
from listenlake.session import freeze


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per row and broken rule."""
    return df.select(key, F.explode(failed_rules(rules)).alias("rule"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def taken(candidates: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    """Candidates whose value is already in use."""
    return candidates.join(existing.select(column), column, "left_semi")


def with_reference(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return df.join(dimension.select(key), key, "left_semi")


def without_reference(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return df.join(dimension.select(key), key, "left_anti")


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their reasons, from one pass written once."""
    checked = freeze(df.withColumn("_reasons", failed_rules(rules)), "checked")
    good = checked.where(F.size("_reasons") == 0).drop("_reasons")
    bad = checked.where(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")
    return good, bad


def set_aside(df: DataFrame, reason: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a ``reason``, and the others, which go to a side table at ``path``.

    Both come from one pass that is written once, under ``aside=false`` and ``aside=true``.
    """
    df.withColumn("aside", F.col(reason).isNotNull()).write.partitionBy("aside").parquet(path)
    written = df.sparkSession.read.schema(f"{ddl(df)}, aside boolean").parquet(path)
    return written.where("NOT aside").drop("aside", reason), written.where("aside").drop("aside")


def ddl(df: DataFrame) -> str:
    """A frame's columns as a schema that a reader takes."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
