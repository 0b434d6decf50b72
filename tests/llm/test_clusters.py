"""Plain Lloyd against a plain loop in Python's integers."""

import hashlib
import math

from gleanwork.llm import clusters

VECTORS = "vec_id long, embedding array<double>"


def plain(rows, dims, k, rounds, scale, seed="1"):
    """vec_id, cluster, distance of each vector and the final centroids, by the definition alone."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    return sorted(((i, nearest(v)[1], min(nearest(v)[0], 2**63 - 1)) for i, v in kept), key=repr), centroids


def check(spark, rows, parts=3, **how):
    vectors = spark.createDataFrame(rows, VECTORS).repartition(parts)
    got = clusters.lloyd(vectors, **how).collect()
    want, centroids = plain(rows, how["dims"], how["k"], how["rounds"], how["scale"])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == want
    for r in got:
        assert [int(x) for x in r["centroid"]] == centroids[r["cluster"]]
        assert r["cluster_inertia"] == min(sum(d for _, c, d in want if c == r["cluster"]), 2**63 - 1)
        assert r["cluster_size"] == sum(c == r["cluster"] for _, c, _ in want)
        assert r["inertia"] == min(sum(d for *_, d in want), 2**63 - 1)


def test_rounds_ties_and_repeats(spark):
    rows = [(i, [math.sin(i * 7 + d) * 3 for d in range(4)]) for i in range(120)]
    rows += [(i, [0.5, -0.5, 0.25, 0.0]) for i in range(200, 260)]  # ties: equal vectors, some of them first centroids
    rows += [(7, rows[7][1])] * 3 + [(None, [1.0, 1.0, 1.0, 1.0]), (8, [9.0, 9.0, 9.0, 9.0])]
    check(spark, rows, dims=4, k=6, rounds=4, scale=64)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.5, -2.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, -inf]), (10, [1.0, 2.0, 3.0])]
    check(spark, rows, dims=2, k=16, rounds=2, scale=64)


def test_empty_centroid_stays(spark):
    rows = [(i, [0.0, 0.0]) for i in range(5)] + [(9, [4.0, 4.0])]
    check(spark, rows, dims=2, k=4, rounds=2, scale=1)


def test_beyond_64_bits(spark):
    rows = [(1, [1e300, -1e300]), (2, [3e30, 2.0]), (3, [1e18, -7.5]), (4, [-1e18, 1.5]), (5, [0.1, -0.1]), (6, [2.0**61, -(2.0**61)]), (7, [2.0**61, -(2.0**61)])]
    for k in (1, 3):
        check(spark, rows, dims=2, k=k, rounds=3, scale=64)
    many = [(i, [2.0**55, 1.0]) for i in range(300)]  # every square fits no longer, and sums would leave 64 bits
    check(spark, many, parts=1, dims=2, k=2, rounds=1, scale=64)


def test_empty_and_clashing_columns(spark):
    vectors = spark.createDataFrame([], VECTORS).selectExpr("*", "1 AS cluster", "'x' AS v", "2 AS distance")
    assert clusters.lloyd(vectors).count() == 0
    one = spark.createDataFrame([(5, [0.5] * 64)], VECTORS).selectExpr("*", "1 AS cluster", "'x' AS v", "2 AS distance")
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in clusters.lloyd(one).collect()] == [(5, 0, 0)]
