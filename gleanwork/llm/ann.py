"""Approximate nearest neighbours: a robust-pruned directed graph per shard.

Vectors are spread over shards of bounded size. In each shard's task the points are
inserted in batches: a greedy beam search over the graph so far proposes neighbours
for every point of the batch at once, relaxed distance pruning (an edge goes if a
kept neighbour is ``alpha`` times nearer to its end) keeps diverse ones, and reverse
edges are added and pruned alike. Equal vectors are one node that carries all their
ids, so groups of copies of any size cost no edges and lose no ids. The index is a
table with one row per vector. A search takes every block of queries to every shard,
runs the beam search there and merges the shards' best by exact cosine.

Nulls and edge cases: vectors that are null, empty or zero, or hold null or
non-finite components, and rows without vec_id take no part; vectors of different
lengths are never compared; a vec_id that occurs on several rows is one vector's name,
so those rows are no candidates of each other; ties go to the smaller vec_id; with no
candidate a query has no row; only vec_id and embedding are read. Every row is
indexed; what a beam search misses is measured by the recall test (at least 0.9).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.llm.common import materialize
from gleanwork.llm.vectors import clean_vectors, dealt, on_grid, wide

INDEX = "cell int, node int, vec_ids array<long>, v {v}, edges array<int>"
FOUND = "query_id long, vec_id long, score double"


def beam_search(points: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For all queries in lockstep: the beam's nodes (-1: none) and squared distances, nearest first.

    ``points`` and ``queries`` have unit length, ``edges`` is (nodes, degree) padded with -1.
    """
    n, q = len(points), len(queries)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n), dtype=bool)
    nodes = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((q, beam), dtype=bool)
    fresh = np.broadcast_to(starts, (q, len(starts)))
    live = np.arange(q)
    while True:
        ok = (fresh >= 0) & ~seen[live[:, None], fresh]
        at = np.where(ok, fresh, 0)
        d = np.where(ok, 2.0 - 2.0 * np.einsum("qkd,qd->qk", points[at], queries[live]), np.inf).astype(np.float32)
        seen[np.broadcast_to(live[:, None], fresh.shape)[ok], fresh[ok]] = True
        all_n = np.concatenate([nodes[live], np.where(ok, fresh, -1)], axis=1)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_o = np.concatenate([open_[live], ok], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        pick = np.arange(len(live))[:, None]
        nodes[live], dist[live], open_[live] = all_n[pick, best], all_d[pick, best], all_o[pick, best]
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            return nodes, dist
        nxt = open_[live].argmax(axis=1)  # the beam is sorted: the nearest node not expanded yet
        open_[live, nxt] = False
        fresh = edges[nodes[live, nxt]]


def robust_prune(points: np.ndarray, of: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of ``of``, at most ``degree`` of its pool (padded with -1): nearest first, and none
    that a kept one is alpha times nearer to."""
    ok = (pool >= 0) & (pool != of[:, None])
    vec = points[np.where(ok, pool, 0)]
    d = np.where(ok, 2.0 - 2.0 * np.einsum("pcd,pd->pc", vec, points[of]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    rows = np.arange(len(of))
    pool, d, vec = pool[rows[:, None], order], d[rows[:, None], order], vec[rows[:, None], order]
    between = 2.0 - 2.0 * np.matmul(vec, vec.transpose(0, 2, 1))
    kept = np.full((len(of), degree), -1, dtype=np.int64)
    for k in range(degree):
        first = np.isfinite(d).argmax(axis=1)
        has = np.isfinite(d[rows, first])
        if not has.any():
            break
        kept[has, k] = pool[rows, first][has]
        gone = alpha * between[rows, first] <= d
        gone[rows, first] = True
        d = np.where(gone & has[:, None], np.inf, d)
    return kept


def unique_rows(pool: np.ndarray) -> np.ndarray:
    """Each row without repeats (they become -1)."""
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    return pool


def build_graph(points: np.ndarray, degree: int, beam: int, alpha: float, batch: int = 256) -> np.ndarray:
    """edges (nodes, degree) over unit vectors; node 0 is where searches start."""
    n = len(points)
    edges = np.full((n, degree), -1, dtype=np.int64)
    used = np.zeros(n, dtype=np.int64)
    at = 1
    while at < n:
        new = np.arange(at, min(n, at + min(batch, max(1, at))))
        near, _ = beam_search(points[:at], edges[:at], np.array([0]), points[new], beam)
        kept = robust_prune(points, new, near, degree, alpha)
        edges[new], used[new] = kept, (kept >= 0).sum(axis=1)
        source, target = np.repeat(new, degree)[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(ends), batch):
            e, f, c = ends[lo : lo + batch], first[lo : lo + batch], count[lo : lo + batch]
            pool = np.full((len(e), degree + c.max()), -1, dtype=np.int64)
            pool[:, :degree] = edges[e]
            for i in range(len(e)):
                pool[i, degree : degree + c[i]] = source[f[i] : f[i] + c[i]]
            full = used[e] + c > degree
            roomy = np.flatnonzero(~full)
            for i in roomy:
                edges[e[i], used[e[i]] : used[e[i]] + c[i]] = source[f[i] : f[i] + c[i]]
            used[e[roomy]] += c[roomy]
            if full.any():
                again = robust_prune(points, e[full], unique_rows(pool[full]), degree, alpha)
                edges[e[full]], used[e[full]] = again, (again >= 0).sum(axis=1)
        at = int(new[-1]) + 1
    return edges


def unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def index_shard(shard: pd.DataFrame, degree: int, beam: int, alpha: float) -> pd.DataFrame:
    out, node = [], 0
    for _, same in shard.sort_values("vec_id").groupby(shard["v"].map(len)):
        names: dict[bytes, list[int]] = {}
        vectors: dict[bytes, np.ndarray] = {}
        for i, v in zip(same["vec_id"], same["v"], strict=True):
            key = np.asarray(v, dtype=np.float64).tobytes()
            vectors.setdefault(key, v)
            if names.setdefault(key, [])[-1:] != [i]:
                names[key].append(i)
        edges = build_graph(unit(wide(vectors.values())), degree, beam, alpha)
        out.append(pd.DataFrame({"cell": shard["cell"].iloc[0], "node": np.arange(node, node + len(vectors)), "vec_ids": list(names.values()), "v": list(vectors.values()), "edges": [e[e >= 0].astype(np.int32) for e in edges]}))
        node += len(vectors)
    return pd.concat(out)


def search_shard(shard: pd.DataFrame, block: pd.DataFrame, k: int, beam: int, batch: int = 256) -> pd.DataFrame:
    found: list[tuple[int, int, float]] = []
    if len(shard) and len(block):
        shard = shard.sort_values("node").assign(d=shard["v"].map(len))
        for d, queries in block.groupby(block["v"].map(len)):
            same = shard[shard["d"] == d]
            if not len(same):
                continue
            exact = wide(same["v"])
            points, ids = unit(exact), same["vec_ids"].to_list()
            edges = np.full((len(same), max(1, same["edges"].map(len).max())), -1, dtype=np.int64)
            for i, e in enumerate(same["edges"]):
                edges[i, : len(e)] = e
            norm = np.sqrt((exact * exact).sum(axis=1))
            for lo in range(0, len(queries), batch):
                own = queries["vec_id"].to_numpy()[lo : lo + batch]
                q = wide(queries["v"].iloc[lo : lo + batch])
                near, _ = beam_search(points, edges, np.array([0]), unit(q), min(beam, len(same)))
                for i, name in enumerate(own):
                    at = near[i][near[i] >= 0]
                    score = (exact[at] * q[i]).sum(axis=1) / (norm[at] * np.sqrt((q[i] * q[i]).sum()))
                    # ids of equal vectors are sorted: the first k that aren't the query's own suffice
                    each = [(x, s) for a, s in zip(at, score, strict=True) for x in [y for y in ids[a][: k + 1] if y != name][:k]]
                    each.sort(key=lambda p: (-p[1], p[0]))
                    found.extend((name, x, s) for x, s in each[:k])
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def build_index(vectors: DataFrame, shard_rows: int = 4096, degree: int = 24, beam: int = 64, alpha: float = 1.2) -> tuple[DataFrame, int]:
    """The index, one row per distinct vector of a shard with its ids and out-edges, and the number of shards."""
    vectors = clean_vectors(vectors, allow_zero=False)
    n = max(1, -(-vectors.count() // shard_rows))
    placed = vectors.withColumn("cell", dealt(vectors, n, 11))
    schema = INDEX.format(v=vectors.schema["v"].dataType.simpleString())
    return materialize(placed.groupBy("cell").applyInPandas(lambda s: index_shard(s, degree, beam, alpha), schema)), n


def search(index: DataFrame, n_shards: int, queries: DataFrame, k: int = 5, beam: int = 96, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine that the beam searches find."""
    queries = clean_vectors(queries, allow_zero=False).dropDuplicates(["vec_id", "v"])
    n_blocks = max(1, -(-queries.count() // block_rows))
    found = on_grid(index, queries, n_shards, n_blocks, 13).applyInPandas(lambda s, b: search_shard(s, b, k, beam), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id on several rows may be found in several shards
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    index, n = build_index(vectors)
    return search(index, n, vectors.where(F.col("vec_id") % 50 == 0))
