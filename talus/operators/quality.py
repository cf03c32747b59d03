"""Data-quality checks: each gives offenders; ``summary`` adds how many there are, so an empty result shows too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(check: str, offenders: DataFrame, key: str) -> DataFrame:
    """(check, offenders, first)."""
    return offenders.agg(F.lit(check).alias("check"), F.count("*").alias("offenders"), F.min(F.col(key).cast("string")).alias("first"))


def not_contiguous(chunks: DataFrame, unit: str | list[str], index: str, total: str) -> DataFrame:
    """Units whose numbers are not 0 to n - 1 or whose total is wrong."""
    keys = [unit] if isinstance(unit, str) else unit
    n = chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.max(index).alias("top"), F.count_distinct(index).alias("k"), F.max(total).alias("t1"), F.min(total).alias("t0"))
    return n.where("top + 1 <> n or k <> n or t0 <> n or t1 <> n").select(*keys)


def avoidable_short(chunks: DataFrame, unit: str, index: str, size: str, least: int, most: int) -> DataFrame:
    """Short chunks that would fit a neighbour of their unit."""
    w = Window.partitionBy(unit).orderBy(index)
    room = F.least(F.coalesce(F.lag(size).over(w), F.lit(10**9)), F.coalesce(F.lead(size).over(w), F.lit(10**9)))
    return chunks.withColumn("_room", room).where((F.col(size) < least) & (F.col("_room") + 1 + F.col(size) <= most)).drop("_room")


def inconsistent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("values")).where("values > 1")


def require(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """``df``, raising when a row breaks the condition; the message is built for that row only."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
