import math

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import topk


def brute(rows, queries, k, scale):
    out = []
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    for q, v in dict(r for r in rows if r[0] in queries).items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_query_matches_sql(same_as_sql):
    same_as_sql("op2_exact_topk")


def test_ties_nulls_and_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.choice([-0.5, 0.0, 0.25, 1.0], 6)]) for i in range(200)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [1.0, 1.0]), (305, []), (7000, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    ids = {0, 3, 100, 304, 302}
    for k, block in ((10, 4096), (3, 2), (500, 4096)):
        monkeypatch.setattr(topk, "BLOCK", block)
        got = sorted(map(tuple, topk.top_k(df.repartition(3), df.where(F.col("vec_id").isin(*ids)), k).collect()))
        assert got == brute(rows, ids, k, 1024)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    one = df.where("vec_id = 3")
    assert topk.top_k(one, one).count() == 0
