"""Exact and approximate vector search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from gleanwork.llm import ann, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=1500, d=24, seed=3):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, d)).astype(np.float32)
    v[100:160] = v[50]  # a group of copies
    v[0] = v[50]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [float("nan")] * d, 0), (n + 3, [None] + [1.0] * (d - 1), 0), (n + 4, [0.0] * d, 0), (None, [1.0] * d, 0), (n + 5, [1.0, 2.0], 0), (7, rows[7][1], 0)]
    return v, spark.createDataFrame(rows + odd, VECTORS).withColumn("score", F.lit("clash"))


def test_exact_top_k(spark, folder):
    v, df = vectors(spark)
    got = topk.op3_topk(spark, folder(embeddings=df)).collect()
    grid = np.vstack([np.floor(v.astype(np.float64) * 1024).astype(np.int64), np.zeros((1, v.shape[1]), np.int64)])
    ids = np.array([*range(len(v)), len(v) + 4])
    for q in range(0, len(v), 100):
        score = grid @ grid[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:10]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(k + 1, ids[i], score[i]) for k, i in enumerate(order)]
    assert topk.op3_topk(spark, folder(**{"empty/embeddings": df.limit(0)}) + "/empty").count() == 0


def test_small_cells_and_blocks_give_the_same(spark):
    _, df = vectors(spark, 600)
    q = df.where("vec_id % 20 = 0")
    one = {tuple(r) for r in topk.exact_top_k(df, q).collect()}
    assert one == {tuple(r) for r in topk.exact_top_k(df, q, cell_rows=97, block_rows=11).collect()}


def test_large_components_are_exact(spark):
    import duckdb

    rows = [(0, [2e6, 2e6, 2e6]), (1, [2e6, 2e6, 2e6]), (2, [1e10, 0.0, 1.0]), (3, [-1e10, 5.0, 1.5]), (4, [1e300, 1.0, -1e300]), (5, [0.5, 0.25, -0.125]), (6, [0.5, 0.25, -0.125]), (100, [1e17, -1e17, 3.0]), (7, [0.5, 0.25, -0.125])]
    df = spark.createDataFrame([*rows, (7, [0.5, 0.25, -0.125])], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.exact_top_k(df, df, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    grid = {i: [int(x) * 1024 if abs(x) > 1e15 else int(np.floor(x * 1024)) for x in v] for i, v in rows}
    for q, v in grid.items():
        want = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in [*grid.items(), (7, grid[7])] if i != q)
        assert sorted(got[q]) == [(n, i, max(-topk.LARGEST, min(topk.LARGEST, -s))) for n, (s, i) in enumerate(want, 1)]
    plain = df.where("vec_id in (0, 1, 5, 6, 7)").selectExpr("vec_id * 100 AS vec_id", "transform(embedding, x -> CAST(x / 1000 AS FLOAT)) AS embedding")
    con = duckdb.connect()
    con.register("embeddings", plain.toPandas())
    told = con.sql(topk.OP3_SQL)
    mine = topk.exact_top_k(plain, plain).select(*told.columns).collect()
    assert sorted(map(tuple, mine)) == sorted(told.fetchall())


def test_recall_over_several_shards(spark):
    v, df = vectors(spark, 3000, 32, seed=9)
    index, n = ann.build_index(df, shard_rows=400)
    got = {}
    for r in ann.search(index, n, df.where("vec_id % 50 = 0"), block_rows=17).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(v), 50):
        cos = u @ u[q]
        cos[q] = -2
        hits += sum(s >= np.sort(cos)[-5] - 1e-9 for s in got[q].values())
        assert len(got[q]) == 5
    assert n == 8 and hits / (5 * 60) >= 0.95


def test_graph_recall_and_copies(spark, folder):
    v, df = vectors(spark)
    got = ann.op6_ann(spark, folder(embeddings=df)).collect()
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, len(v), 50):
        cos = u @ u[q]
        cos[q] = -2
        best = np.sort(cos)[-5:]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - cos[r["vec_id"]]) < 1e-6 for r in mine)
        hits += sum(r["score"] >= best[0] - 1e-9 for r in mine)
        total += 5
    assert hits / total >= 0.9
    zero = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])]
    assert zero == [50, 100, 101, 102, 103]
    index, _ = ann.build_index(df)
    assert index.select(F.sum(F.size("vec_ids"))).first()[0] == len(v) + 1
    assert ann.op6_ann(spark, folder(**{"empty/embeddings": df.limit(0)}) + "/empty").count() == 0
