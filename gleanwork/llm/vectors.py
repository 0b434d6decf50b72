"""Shared by the two vector searches: clean vectors, and a grid of candidate cells by query blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_vectors(vectors: DataFrame, allow_zero: bool = True, need_id: bool = True) -> DataFrame:
    """vec_id, v of the vectors that take part: not null or empty, all components finite. v keeps its type; tasks widen it to double."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    out = vectors.select("vec_id", F.col("embedding").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    out = out.where("vec_id IS NOT NULL") if need_id else out
    return out if allow_zero else out.where(F.exists("v", lambda x: x != 0))


def wide(vectors) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def dealt(rows: DataFrame, n: int, salt: int) -> Column:
    """One of n places by hash of the row, not of its id, so no repeated id or vector fills one place."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(salt)), F.lit(n)).cast("int")


def on_grid(cells: DataFrame, queries: DataFrame, n_cells: int, n_blocks: int, salt: int):
    """Grouped ``cells`` rows (with a column cell) and ``queries`` rows, each pair of a cell and a query block once.

    Cells are copied to every query block and queries to every cell, so a task holds one
    cell and one block: both are of bounded size, however many queries or vectors there are.
    """
    left = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = queries.withColumn("block", dealt(queries, n_blocks, salt)).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block"))
