"""Input columns named like an operator's internal ones come out as they went in."""

import pytest
from plain import prose

from parcelflow.llm.op1_substring_dedup import substring_dedup, without_repeats
from parcelflow.llm.op6_best_fit_packing import best_fit_packing
from parcelflow.llm.op9_decontaminate import clean_documents, decontaminate

NAMES = ["__part", "__body", "__salt", "__n", "__rank", "__before", "__item_ids", "__hit_spans", "__key", "c0", "C1", "part", "body"]


@pytest.fixture(scope="module")
def documents(spark):
    import random

    rng = random.Random(6)
    shared = prose(rng, 40)
    rows = [(i, *(f"{name} {i}" for name in NAMES), f"{shared} {prose(rng, 30)}" if i % 2 else prose(rng, 50)) for i in range(6)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", *(f"`{n}` string" for n in NAMES), "text string"]))


def _same(found):
    assert [c for c in found.columns if c in NAMES] == NAMES
    rows = found.collect()
    assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in NAMES)
    return {r["doc_id"]: r for r in rows}


def test_repeats(documents):
    got = _same(substring_dedup(documents))
    assert {d: r["n_removed"] for d, r in got.items()} == {0: 0, 1: 0, 2: 0, 3: 40, 4: 0, 5: 40}
    assert set(_same(without_repeats(documents))) == set(range(6))


def test_packing(documents):
    assert all(len(r["ids"]) == r["length"] for r in _same(best_fit_packing(documents)).values())


def test_benchmark(spark, documents):
    items = spark.createDataFrame([(9, documents.filter("doc_id = 2").first()["text"])], "item_id long, text string")
    got = _same(decontaminate(documents, items))
    assert {d: (r["item_ids"], r["contaminated"]) for d, r in got.items()} == {d: ([9], True) if d == 2 else ([], False) for d in range(6)}
    assert set(_same(clean_documents(documents, items))) == {0, 1, 3, 4, 5}
