import random

import pytest
from plain import DOCUMENTS, contamination, odd_documents, ordered, prose

from parcelflow.llm.op9_decontaminate import clean_documents, decontaminate

ITEMS = "item_id long, text string"


def _items(rows):
    rng = random.Random(4)
    words = rows[4][1].split()
    long_ = rows[35][1].split()
    return [(1, " ".join(words[:12])), (2, "nothing of this " * 4), (3, " ".join(long_[5:40]).upper()), (4, "W7"), (5, None), (6, ""), (7, "w1 w2 w3"),
            (8, prose(rng, 30)), (None, " ".join(long_[20:33])), (1, "w9 w8"), (9, "é à"), (10, " ".join(long_[3:50])), (11, "again " * 25)]


@pytest.mark.parametrize("block_bytes", [1 << 25, 40])
def test_equals_definition(spark, monkeypatch, block_bytes):
    import parcelflow.llm.op9_decontaminate as op

    monkeypatch.setattr(op, "BLOCK_BYTES", block_bytes)
    rows = odd_documents()
    items = _items(rows)
    found = decontaminate(spark.createDataFrame(rows, DOCUMENTS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(map(str, r["item_ids"]))) for r in found]
    want = contamination(rows, items)
    assert ordered(got) == ordered(want)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in found)


def test_longest_matches(spark):
    rng = random.Random(8)
    passage = prose(rng, 45, 10_000)
    docs = [(1, f"{prose(rng, 30, 10_000)} {passage} {prose(rng, 8, 10_000)}", "en", "s", 1), (2, prose(rng, 80, 10_000), "en", "s", 1)]
    items = [(77, f"Before this, {passage} and after")]
    got = decontaminate(spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(items, ITEMS)).orderBy("doc_id").collect()
    assert [tuple(m) for m in got[0]["matches"]] == [(77, 2, 30, 45)] and not got[1]["matches"]


def test_stage_and_odd_tables(spark):
    rows = odd_documents()
    items = spark.createDataFrame(_items(rows), ITEMS)
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCUMENTS + ", n_hit int")
    got = clean_documents(docs, items)
    assert got.schema.names == docs.schema.names
    clean = [(*r, 1) for r, (_, _, n, _) in zip(rows, contamination(rows, _items(rows)), strict=True) if not n]
    assert ordered(got.collect()) == ordered(clean)
    assert clean_documents(docs, items.limit(0)).count() == len(rows)
    assert clean_documents(docs.limit(0), items).count() == 0
    assert decontaminate(docs, items, matches=False).filter("n_hit = 1").count() == sum(n == 1 for _, _, n, _ in contamination(rows, _items(rows)))
