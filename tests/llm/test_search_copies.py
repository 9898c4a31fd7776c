"""Search among thousands of exact and of near copies, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pickwise.llm import nearest


def test_search_among_copies(spark):
    rng = np.random.default_rng(8)
    one, near = rng.standard_normal((2, 16))
    x = np.concatenate([np.tile(one, (2500, 1)), near + 1e-3 * rng.standard_normal((2500, 16)), rng.standard_normal((500, 16))]).astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    asked = [rows[0], rows[1], rows[2500], rows[2501], rows[5400], (7, (one * 1.1).astype(np.float32).tolist()), (int(ids[9]), rows[5100][1])]
    df = spark.createDataFrame(rows + asked[-1:], "vec_id long, embedding array<float>")
    ids, x = np.append(ids, ids[9]), np.concatenate([x, x[5100:5101]]).astype(np.float64)
    for block_rows in (8192, 700):
        got = nearest.search(df, spark.createDataFrame(asked, df.schema), k=20, rerank=50, block_rows=block_rows).collect()
        for q, v in asked:
            score = (x * np.array(v)).sum(1)
            keep = np.flatnonzero(ids != q)
            best = keep[np.lexsort((ids[keep], -score[keep]))[:20]]
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == ids[best].tolist()


def test_search_within_each_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5 if i < 90 else 3 if i < 130 else 1).tolist()) for i in range(150)] + [(160, None), (180, [0.0, 0.0, 0.0]), (200, [1.0, float("nan"), 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, df.where("vec_id % 20 = 0"), k=7, rerank=4, block_rows=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    good = {i: np.array(v) for i, v in rows[:150]}
    want = {q: [j for _, j in sorted((-float((v * good[q]).sum()), j) for j, v in good.items() if j != q and len(v) == len(good[q]))[:7]] for q in good if q % 20 == 0}
    assert got == want and {len(good[q]) for q in got} == {1, 3, 5}


def test_bounds_hold_and_leave_few_open(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] *= 1e18  # beyond single precision: bounds nothing, stays open
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 100 = 1").withColumn("ask", F.col("vec_id"))
    coded, pairs = nearest.bounds(df, asked, 64, 20, 50, 700)
    place = {r["at"]: r["ids"][0] for r in coded.select("at", "ids").collect()}
    pairs = pairs.cache()
    for r in pairs.collect():
        exact = float(x[r["ask"]] @ x[place[r["at"]]])
        assert r["low"] <= exact <= r["high"]
    left = nearest.still_open(pairs, 20).collect()
    assert {(r["ask"], place[r["at"]]) for r in left} >= {(q, j) for q in range(1, 3000, 100) for j in [j for j in np.argsort(-(x @ x[q])) if j != q][:20]}
    assert len(left) < 0.05 * 30 * 3000
