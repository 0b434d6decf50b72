"""Exact top-k search by columnar branch and bound.

Vectors are spread over cells of bounded size and queries over blocks; each task
gets one cell and one block. A task holds its cell in vertical layout, one row per
dimension, and adds up inner products dimension block by block, the query's heaviest
dimensions first. After each block a candidate's score lies within the remaining
mass, |rest of the query| * |rest of the vector|, of its partial sum; candidates whose
upper bound is under the k-th best lower bound are compacted away. Sums are integers,
so the result is exact; each cell's k best per query are merged at the end.

Nulls and edge cases: vectors that are null or empty, or hold null or non-finite
components, and rows without vec_id take no part; a query is compared with vectors of
its own length only; where products may leave 64 bits, Python's integers are summed
instead, such scores are given as the nearest long and ranked by their logarithm in double
precision; a vec_id that occurs on several rows is one vector's name, so those rows are
no candidates of each other, a candidate row counts as often as it occurs, a repeated
query once; ties go to the smaller vec_id; without any candidate a query has no row;
only vec_id and embedding are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm.vectors import clean_vectors, dealt, on_grid, wide

SCHEMA = "query_id long, vec_id long, score long, beyond double"
LARGEST = 2**63 - 1
DIMENSIONS_AT_ONCE = 8


def best_of_cell(query: np.ndarray, columns: np.ndarray, tails: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the query's k best in a cell: columns is (dimensions, n), tails the squared components."""
    order = np.argsort(-np.abs(query), kind="stable")
    alive = np.flatnonzero(ids != own)
    total = np.zeros(len(alive), dtype=np.int64)
    left = tails.sum(axis=0)[alive] if len(alive) else np.zeros(0)
    weight = np.cumsum((query[order].astype(np.float64) ** 2)[::-1])[::-1]
    for at in range(0, len(order), DIMENSIONS_AT_ONCE):
        dims = order[at : at + DIMENSIONS_AT_ONCE]
        block = columns[np.ix_(dims, alive)]
        total += query[dims] @ block
        if at + DIMENSIONS_AT_ONCE >= len(order):
            break
        left = left - (block.astype(np.float64) ** 2).sum(axis=0)
        if len(alive) > k:
            slack = np.sqrt(weight[at + DIMENSIONS_AT_ONCE] * np.maximum(left, 0.0)) * (1 + 1e-9) + 1.0
            floor = np.partition(total - slack, len(alive) - k)[len(alive) - k]
            keep = total + slack >= floor
            if keep.mean() < 0.8:
                alive, total, left = alive[keep], total[keep], left[keep]
    best = np.lexsort((ids[alive], -total))[:k]
    return ids[alive[best]], total[best]


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in 64 bits, or as Python's integers if any is beyond 2^62."""
    grid = np.floor(v * scale)
    if np.abs(grid).max() < 2**62:
        return grid.astype(np.int64)
    exact = [int(g) if np.isfinite(g) else int(x) * scale for g, x in zip(grid.ravel(), v.ravel(), strict=True)]  # so large, x is an integer
    out = np.empty(len(exact), dtype=object)
    out[:] = exact
    return out.reshape(v.shape)


def best_of_wide_cell(query: np.ndarray, columns: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int, float]]:
    """``best_of_cell`` without bounds, in Python's integers: id, the nearest long, and what orders scores beyond it."""
    alive = np.flatnonzero(ids != own)
    total = query.astype(object) @ columns[:, alive].astype(object) if len(alive) else []
    best = sorted(zip((-s for s in total), ids[alive], strict=True))[:k]
    return [(i, max(-LARGEST, min(LARGEST, -s)), (math.log(abs(s)) if s < 0 else -math.log(abs(s))) if abs(s) > LARGEST else 0.0) for s, i in best]


def search_cell(cell: pd.DataFrame, block: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    out: list[pd.DataFrame] = []
    if len(cell) and len(block):
        cell, block = cell.assign(d=cell["v"].map(len)), block.assign(d=block["v"].map(len))
        for d, queries in block.groupby("d"):
            same = cell[cell["d"] == d]
            if not len(same):
                continue
            ids = same["vec_id"].to_numpy()
            columns = np.ascontiguousarray(scaled(wide(same["v"]), scale).T)
            most = int(np.abs(columns).max())
            tails = columns.astype(np.float64) ** 2 if most < 2**62 else None
            for own, v in zip(queries["vec_id"], queries["v"], strict=True):
                query = scaled(np.asarray(v, dtype=np.float64), scale)
                if d * most * int(np.abs(query).max()) < 2**62:
                    best, score = best_of_cell(query.astype(np.int64), columns, tails, ids, own, k)
                    out.append(pd.DataFrame({"query_id": own, "vec_id": best, "score": score, "beyond": 0.0}))
                else:
                    rows = [(own, *r) for r in best_of_wide_cell(query, columns, ids, own, k)]
                    out.append(pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "beyond"]))
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "beyond": []})
    return pd.concat(out or [empty]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "beyond": "float64"})


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, cell_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the largest integer inner product, per row of ``queries``."""
    vectors, queries = clean_vectors(vectors), clean_vectors(queries).dropDuplicates(["vec_id", "v"])
    n_cells, n_blocks = max(1, -(-vectors.count() // cell_rows)), max(1, -(-queries.count() // block_rows))
    cells = vectors.withColumn("cell", dealt(vectors, n_cells, 3))
    found = on_grid(cells, queries, n_cells, n_blocks, 5).applyInPandas(lambda c, b: search_cell(c, b, k, scale), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP3_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM clean) q JOIN clean c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
