import numpy as np
import pyarrow as pa
import pytest
from plain import DOCUMENTS, odd_documents
from pyspark.sql import functions as F

from parcelflow.llm.op7_quality_ranking import FEATURES, features, fit_bradley_terry, learn_quality, quantile_threshold, score_quality, with_features
from parcelflow.llm.queries import QUERIES
from parcelflow.llm.textbatch import byte_powers


def _auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    y = np.array(labels) == 1
    return (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


def test_pairs_find_the_direction():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(300, 3)) + [1, 0, -1], rng.normal(size=(200, 3))
    w = fit_bradley_terry(good, bad, pairs=4000)
    assert w[0] > 0.5 and w[2] < -0.5 and abs(w[1]) < 0.25
    # the gradient of the logistic loss of feature differences vanishes
    assert not fit_bradley_terry(good[:0], bad).any()


def test_threshold_leaves_the_share_above(spark):
    rng = np.random.default_rng(3)
    for scores, n_bad in ((rng.normal(size=500), 180), (np.arange(15.0) - 3, 5), (np.repeat([-1.0, 0.0, 2.0], 4), 6), (np.array([1.0, 2.0]), 1)):
        ordered = np.sort(scores)
        got = quantile_threshold(spark.createDataFrame([(float(x),) for x in scores], "s double"), n_bad, len(scores))
        assert got == (ordered[n_bad - 1] + ordered[n_bad]) / 2
    assert quantile_threshold(spark.createDataFrame([(1.0,)], "s double"), 0, 1) == 0.0


def test_only_the_fit_is_sampled(spark):
    rng = np.random.default_rng(5)
    n, width = 600, len(FEATURES)
    y = rng.random(n) < 0.6
    x = (rng.normal(size=(n, width)) + y[:, None]).astype(np.float32)
    rows = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(x)], "doc_id long, features array<float>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    w, t = learn_quality(rows, labels, sample_rows=40)
    key = {r["doc_id"]: r["k"] for r in rows.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    pick = {v: sorted(np.flatnonzero(y == v), key=key.get)[:40] for v in (True, False)}
    assert np.allclose(w, fit_bradley_terry(x[pick[True]].astype(float), x[pick[False]].astype(float)))
    s = np.sort(x.astype(float) @ w)
    bad = int((~y).sum())
    assert t == pytest.approx((s[bad - 1] + s[bad]) / 2)
    # one id that holds most rows leaves the bounded pick short
    many = rows.unionByName(rows.filter("doc_id = 7").select("doc_id", "features", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("col"))
    w, t = learn_quality(many, labels, sample_rows=40)
    assert np.isfinite(w).all() and np.isfinite(t) and score_quality(many, w, t).count() == 3600


def test_features_of_odd_texts():
    texts = [t for _, t, *_ in odd_documents()]
    x = features(pa.array(texts), byte_powers())
    assert x.shape == (len(texts), len(FEATURES)) and np.isfinite(x).all() and not x[texts.index(None)].any()
    one = features(pa.array(["a b a a !!"]), byte_powers())[0]
    at = dict(zip(FEATURES, one, strict=True))
    assert at["distinct"] == pytest.approx(3 / 5) and at["adjacent"] == pytest.approx((1 / 5) ** 0.5) and at["most_common"] == pytest.approx((3 / 5) ** 0.5)
    # a text's features do not depend on its batch
    assert np.allclose(x[3], features(pa.array([texts[3]]), byte_powers())[0])


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op7_quality_ranking"](spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    scores, y, predicted = zip(*held, strict=True)
    assert len(held) > 80 and _auc(scores, y) > 0.95 and np.mean(np.array(y) == predicted) > 0.93


def test_odd_labels(spark):
    rows = with_features(spark.createDataFrame(odd_documents(), DOCUMENTS), ["doc_id"])
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (9, 7)], "doc_id long, quality int")
    w, t = learn_quality(rows, none)
    got = score_quality(rows, w, t).collect()
    assert len(got) == len(odd_documents()) and {r["score"] for r in got} == {0.5}
    assert score_quality(rows.limit(0), w, t).count() == 0
