"""Joins whose hot keys don't end in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key on one of so many rows, or on more, is frequent.
FREQUENT = 1000


def join_by_frequency(rows: DataFrame, told: DataFrame, key: str, copies: str, total: int, apart: Column) -> DataFrame:
    """``rows`` left-joined with ``told``, which has one row per ``key`` and says on how many of ``total`` rows it is.

    Keys on a thousandth of the rows or more, of which there are at most a thousand, are broadcast, so no
    task gets all rows of one key; the others meet in a shuffle, or in a broadcast where they are few. Rows that
    have found their key are spread there by ``apart``. The key is a string or binary.
    """
    kind, values = dict(told.dtypes)[key], [c for c in told.columns if c not in (key, copies)]
    often = F.col(copies) * FREQUENT >= total
    frequent = told.where(often).select(F.col(key).alias("__frequent"), *(F.col(c).alias(f"__frequent_{c}") for c in values))
    rare = told.where(~often).select(F.col(key).alias("__rare"), *(F.col(c).alias(f"__rare_{c}") for c in values))
    longer = F.concat(F.col(key), F.lit("-").cast(kind), F.coalesce(apart.cast("string"), F.lit("")).cast(kind))
    marked = rows.join(F.broadcast(frequent), F.col(key) == F.col("__frequent"), "left").withColumn("__place", F.when(F.col("__frequent").isNull(), F.col(key)).otherwise(longer))
    return marked.join(rare, F.col("__place") == F.col("__rare"), "left").select(*rows.columns, *(F.coalesce(f"__frequent_{c}", f"__rare_{c}").alias(c) for c in values))
