"""Plain Lloyd clustering of integer vectors.

Each component x becomes floor(scale * x), so all sums are exact. The first centroids are the
vectors with the smallest hashes of their ids. In every round the centroids go to the tasks, where
``mapInPandas`` computes the squared differences to one centroid after the other in
NumPy; argmin takes the lowest centroid among equals. A partition hands on one sum for each
centroid and dimension, which ``groupBy`` merges; only centroids x dimensions sums come
to the driver, whatever the number of vectors. A centroid that got vectors becomes the floor of
their mean, an empty one stays.

Nulls and edge cases: vectors that are null, have another length than ``dims``, or hold null or
non-finite components take no part; a null vec_id hashes as null, which is last; of equal
hashes (repeated ids) the smaller vector comes first; repeated rows count as often as they
occur; with fewer vectors than ``k`` there are as many centroids as vectors; an empty table
gives an empty result; only vec_id and embedding are read. Where squares may leave 64 bits,
Python's integers are compared; such a distance or inertia is given as the nearest long.
Sums are carried in limbs of 32 bits, so centroids are exact for every double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import materialize, narrow_result
from gleanwork.llm.vectors import clean_vectors, wide

LARGEST = 2**63 - 1
LIMB = 32
#: Vectors compared at once: with 64 dimensions, 2 MB for each array of differences.
SLICE = 4096
SUMS = "cluster int, dim int, limb int, total long"


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers while every square fits, else Python's."""
    if not vectors.size:
        return vectors.astype(np.int64)
    most = np.abs(vectors).max()
    if most * scale < 2.0**62:
        return np.floor(vectors * scale).astype(np.int64)
    # from 2^53 on a double is an integer, and scale may carry the product beyond the largest double
    exact = [int(np.floor(x * scale)) if abs(x) < 2.0**53 else int(x) * scale for x in vectors.ravel().tolist()]
    out = np.empty(len(exact), dtype=object)
    out[:] = exact
    return out.reshape(vectors.shape)


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centroid, the smaller number among equals, and the squared distance."""
    most = max([int(np.abs(points).max()), *(abs(c) for row in centroids for c in row)])
    fits = points.shape[1] * (2 * most) ** 2 < 2**63
    points = points.astype(np.int64 if fits else object)
    squares = np.empty((len(points), len(centroids)), dtype=points.dtype)
    for c, row in enumerate(centroids):
        apart = points - np.array(row, dtype=points.dtype)
        squares[:, c] = np.einsum("ij,ij->i", apart, apart) if fits else (apart * apart).sum(axis=1)
    at = squares.argmin(axis=1) if fits else np.array([min(range(len(r)), key=r.__getitem__) for r in squares], dtype=np.int64)
    return at, squares[np.arange(len(points)), at]


def limbs(sums: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, limb, digit) whose digit * 2^(32 * limb) add up to each sum; plain 64-bit sums are one digit."""
    out = []
    for i, s in enumerate(int(x) for x in sums):
        limb, sign, s = 0, -1 if s < 0 else 1, abs(s)
        if s < 2**62:
            out.append((i, 0, sign * s))
            continue
        while s:
            out.append((i, limb, sign * (s & (2**LIMB - 1))))
            limb, s = limb + 1, s >> LIMB
    return out


def partition_sums(frames: Iterator[pd.DataFrame], centroids: list[list[int]], scale: int) -> Iterator[pd.DataFrame]:
    """For each centroid that got vectors here: their number (dim -1) and the sum of each dimension."""
    count = [0] * len(centroids)
    total = [np.zeros(len(row), dtype=object) for row in centroids]
    for frame in frames:
        for start in range(0, len(frame), SLICE):
            points = integers(wide(frame["v"].iloc[start : start + SLICE]), scale)
            at, _ = nearest(points, centroids)
            for c in np.unique(at).tolist():
                mine = points[at == c]
                # a slice's sum may leave 64 bits although its members don't
                small = mine.dtype != object and int(np.abs(mine).max()) < 2**62 // len(mine)
                total[c] = total[c] + (mine if small else mine.astype(object)).sum(axis=0).astype(object)
                count[c] += len(mine)
    rows = [(c, -1, 0, n) for c, n in enumerate(count) if n]
    rows += [(c, dim, limb, digit) for c, n in enumerate(count) if n for dim, limb, digit in limbs(total[c])]
    yield pd.DataFrame(rows, columns=["cluster", "dim", "limb", "total"])


def assigned(frames: Iterator[pd.DataFrame], centroids: list[list[int]], scale: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), SLICE):
            part = frame.iloc[start : start + SLICE]
            at, distance = nearest(integers(wide(part["v"]), scale), centroids)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": at.astype("int32"), "distance": [min(int(d), LARGEST) for d in distance]})


def first_centroids(vectors: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The k vectors with the smallest lowercase-hex sha256 of ``seed:vec_id``."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(hashed.asc_nulls_last(), "v").select("v").limit(k).collect()
    return [[int(x) for x in integers(np.array([r["v"]], dtype=np.float64), scale)[0]] for r in rows]


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round."""
    sums = vectors.select("v").mapInPandas(lambda frames: partition_sums(frames, centroids, scale), SUMS)
    merged = sums.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()  # centroids x dimensions
    total: dict[tuple[int, int], int] = {}
    for r in merged:
        total[r["cluster"], r["dim"]] = total.get((r["cluster"], r["dim"]), 0) + (int(r["total"]) << (LIMB * r["limb"]))
    return [[total[c, d] // total[c, -1] for d in range(len(row))] if (c, -1) in total else row for c, row in enumerate(centroids)]


@narrow_result
def lloyd(vectors: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, cluster_size and the cluster's final centroid, for each vector that takes part."""
    spark = vectors.sparkSession
    kept = vectors.where(F.size("embedding") == dims).transform(clean_vectors, need_id=False)
    centroids = first_centroids(kept, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, scale)
    told = materialize(kept.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInPandas(lambda frames: assigned(frames, centroids, scale), "vec_id long, cluster int, distance long"))
    sums = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.count("*").alias("n")).collect()  # one row per centroid
    whole = sum(int(r["inertia"]) for r in sums)
    rows = [(r["cluster"], min(int(r["inertia"]), LARGEST), min(whole, LARGEST), r["n"], [str(x) for x in centroids[r["cluster"]]]) for r in sums]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, cluster_size long, centroid array<string>")
    return told.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "cluster_size", "centroid")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.concat_ws(",", "centroid"), 256)
    return told.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


_FIRST = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v FROM kept QUALIFY cluster < 16
)"""
_ROUND = """, a{r} AS MATERIALIZED (
  SELECT uid, vec_id, kept.v, cluster,
         CAST(list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i]))) AS BIGINT) AS distance
  FROM kept, c{r} c QUALIFY row_number() OVER (PARTITION BY uid ORDER BY distance, cluster) = 1
)"""
_MOVE = """, m{r} AS (
  SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i
), c{n} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c
  LEFT JOIN (SELECT cluster, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM m{r} GROUP BY cluster) m ON c.cluster = m.cluster
)"""
OP12_SQL = (
    _FIRST
    + "".join(_ROUND.format(r=r) + _MOVE.format(r=r, n=r + 1) for r in range(3))
    + _ROUND.format(r=3)
    + """
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON a.cluster = c.cluster
"""
)
