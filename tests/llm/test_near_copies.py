import random

import numpy as np
import pyarrow as pa
from plain import DOCUMENTS, edited, near_copy_groups, odd_documents, ordered, prose, shingle_set

import corpus_pipeline
from parcelflow.llm import near_copies
from parcelflow.llm.near_copies import band_keys, one_of_near_copies, shingle_sets


def _kept(rows):
    """The ids that stay, by all pairs."""
    return ordered((min((r[0] for r in group if r[0] is not None), default=None),) for group in near_copy_groups(rows))


def test_stage_removes_edited_copies(spark):
    rng = random.Random(4)
    rows = []
    for g in range(40):
        text = prose(rng, 200, 5000)
        rows += [(10 * g, text, "en", "s", 1), *((10 * g + k, edited(rng, text, k), "en", "s", 1) for k in range(1, 6))]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    want = _kept(rows)
    assert ordered(got.select("doc_id").collect()) == want and len(want) < 80


def test_large_group_and_odd_rows(spark):
    rng = random.Random(5)
    text = prose(rng, 120, 5000)
    # every copy is near the first text, hardly ever near another copy
    rows = [(1000 + i, edited(rng, text, 2), "en", "s", 1) for i in range(150)] + [(5000, text, "en", "s", 1)]
    rows += [r for r in odd_documents() if r[0] is not None] + [(400, "a b c", "en", "s", 1), (401, "A  b c", "en", "s", 1), (402, "a b d", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = one_of_near_copies(docs)
    assert got.schema.names == docs.schema.names
    assert ordered(got.select("doc_id").collect()) == _kept(rows)
    assert one_of_near_copies(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x y", "en", "s", 1), (None, "x y", "en", "s", 2), (3, "z", "en", "s", 1)], DOCUMENTS)
    assert ordered(one_of_near_copies(nulls).select("doc_id", "text").collect()) == ordered([(None, "x y"), (3, "z")])


def test_families_that_share_passages(spark):
    """Families whose copies are near the original only, chains of copies, and one passage inside many other texts."""
    rng = random.Random(6)
    passage, rows = prose(rng, 70, 9000), []
    for g in range(12):
        text = f"{prose(rng, 60, 9000)} {passage} {prose(rng, 30, 9000)}"
        rows += [(100 * g + 50, text, "en", "s", 1), *((100 * g + k, edited(rng, text, 3), "en", "s", 1) for k in range(20))]
    chain = prose(rng, 150, 9000)
    for k in range(25):  # each is near the one before it
        rows.append((5000 + k, chain, "en", "s", 1))
        chain = edited(rng, chain, 2)
    rows += [(6000 + k, f"{passage} {prose(rng, 20 + k, 9000)}", "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    want = _kept(rows)
    assert ordered(one_of_near_copies(docs).select("doc_id").collect()) == want and 72 < len(want) < len(rows) - 150


def test_sets_and_keys_do_not_depend_on_the_batch():
    texts = [r[1] for r in odd_documents()]
    together = shingle_sets(pa.array(texts, pa.string()))
    for t, s in zip(texts, together, strict=True):
        assert len(s) == len(shingle_set(t)) and np.array_equal(s, shingle_sets(pa.array([t], pa.string()))[0])
    some = [s for s in together if len(s)]
    assert np.array_equal(band_keys(some), np.concatenate([band_keys([s]) for s in some]))
    assert band_keys(some).shape[1] == near_copies.BANDS


def test_components_of_fingerprints_are_buckets(spark):
    """Operator 8 is a step of the stage: chains of fingerprints two bits apart share a bucket, others do not."""
    fps = [0, 3, 15, 1 << 40, (1 << 40) | (1 << 50), -1]
    nodes = spark.createDataFrame([(i, fp, 10) for i, fp in enumerate([*fps, 15])], "node long, fp long, size long")
    got = near_copies._simhash_postings(nodes).groupBy("key").agg({"node": "collect_set"}).collect()
    assert sorted(sorted(r[1]) for r in got) == [[0, 1, 2, 3, 4, 6], [5]]


def test_stage_asks_for_components(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "fingerprint_components", lambda d: asked.append(d.columns) or d.selectExpr("*", "fp AS label"))
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 1), (2, "d e f", "en", "s", 1)], DOCUMENTS)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 2 and asked == [["fp"]]
