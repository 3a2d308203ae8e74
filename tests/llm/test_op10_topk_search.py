import math

import numpy as np
import pytest
from plain import ordered
from pyspark.sql import functions as F

from parcelflow.llm.op10_topk_search import top_k_search

ROWS = "vec_id long, embedding array<float>, label int"


def _plain(rows, queries, top):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    usable = [(i, whole(v)) for i, v, *_ in rows if i is not None and whole(v) is not None]
    asked = {(i, tuple(whole(v))) for i, v, *_ in queries if i is not None and whole(v) is not None}
    out = []
    for q, vector in asked:
        long = (1 << 63) - 1
        scored = sorted((-max(-long, min(long, sum(a * b for a, b in zip(vector, v, strict=False)))), i) for i, v in usable if i != q)[:top]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    return out


def _vectors(seed, n=600, width=12):
    rng = np.random.default_rng(seed)
    scale = rng.lognormal(0, 1, n)[:, None]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(n, width)) * scale)]
    rows += [(2000 + i, rows[50][1], 1) for i in range(80)]
    rows += [(3000, None, None), (3001, [1.0, None], 0), (3002, [float("nan")] * width, 0), (3003, [float("inf")] * width, 0), (3004, [0.0] * width, 0),
             (3005, [], 0), (3006, [1.0], 0), (None, rows[1][1], 0), rows[7], rows[7], (100, rows[3][1], 0), (3050, [3e30] + [0.0] * 11, 0), (3051, [-1e-9] * width, 0)]
    return rows


@pytest.mark.parametrize(("top", "block", "bucket", "seed_rows"), [(5, 8192, 1024, 4096), (3, 7, 50, 20), (1, 5, 16, 0)])
def test_equals_all_products(spark, monkeypatch, top, block, bucket, seed_rows):
    import parcelflow.llm.op10_topk_search as op

    monkeypatch.setattr(op, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(op, "SEED_ROWS", seed_rows)
    rows = _vectors(top)
    frame = spark.createDataFrame(rows, ROWS)
    queries = frame.filter(F.col("vec_id") % 50 == 0)
    got = top_k_search(frame.repartition(5), queries, top=top, block=block)
    want = _plain(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], top)
    assert ordered(got.select("query_id", "rank", "vec_id", "score").collect()) == ordered(want)


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], ROWS)
    assert ordered(top_k_search(frame, frame.filter("vec_id = 0")).collect()) == [(0, 1, 1, 256 * 512)]
    assert top_k_search(frame.limit(0), frame.limit(0)).count() == 0
    assert top_k_search(frame.limit(0), frame).count() == 0
    more = frame.selectExpr("*", "1 AS score", "2 AS norm", "3 AS rank")
    assert top_k_search(more, more).count() == 2


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 2.0 ** rng.integers(0, 40)], 0) for i in range(200)]
    rows += [(500, [2e6, 1.0, 0.0], 0), (501, [3e6, 1.0, 0.0], 0), (502, [3e30, -3e30, 1.0], 0), (503, [-3e30, 3e30, 1.0], 0), (504, [2.0**40, 2.0**40, -1.0], 0)]
    vectors = spark.createDataFrame(rows, ROWS)
    queries = [r for r in rows if r[0] % 10 == 0 or r[0] >= 500]
    got = top_k_search(vectors, spark.createDataFrame(queries, ROWS), top=5)
    assert ordered(got.collect()) == ordered(_plain(rows, queries, 5))
    pair = vectors.filter("vec_id IN (500, 501)")
    assert {r["score"] for r in top_k_search(pair, pair).collect()} == {393_216_000_000_065_536}
