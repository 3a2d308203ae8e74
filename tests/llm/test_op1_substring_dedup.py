import random

import numpy as np
import pyarrow as pa
import pytest
from plain import DOCUMENTS, SPACED, odd_documents, ordered, prose, repeats, sha

from parcelflow.llm import op1_substring_dedup as op1
from parcelflow.llm.op1_substring_dedup import substring_dedup, without_repeats
from parcelflow.llm.worker import tidy


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_equals_definition(spark, buckets):
    rows = odd_documents()
    got = substring_dedup(spark.createDataFrame(rows, DOCUMENTS).repartition(3), buckets=buckets)
    want = [(d, n, gone, sha(kept), kept) for d, n, gone, kept in repeats(rows)]
    assert ordered(got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()) == ordered(want)


def test_spans_are_maximal(spark):
    rows = odd_documents(2)
    got = substring_dedup(spark.createDataFrame(rows, DOCUMENTS), size=5)
    for r in got.join(spark.createDataFrame(rows, DOCUMENTS).select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        spans = [(s["start"], s["stop"]) for s in r["removed_spans"]]
        assert sum(b - a for a, b in spans) == r["n_removed"]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        words = SPACED.findall(r["text"] or "")
        gone = {i for a, b in spans for i in range(a, b)}
        assert " ".join(w for i, w in enumerate(words) if i not in gone) == r["kept_text"]


def test_flushes_and_slices_do_not_matter(spark, monkeypatch):
    import parcelflow.llm.op1_substring_dedup as op

    monkeypatch.setattr(op, "_FLUSH_WINDOWS", 50)
    monkeypatch.setattr(op, "_SLICE_BYTES", 300)
    rows = odd_documents(3)
    got = substring_dedup(spark.createDataFrame(rows, DOCUMENTS), size=4, outputs=())
    want = [(d, n, gone, sha(kept)) for d, n, gone, kept in repeats(rows, 4)]
    assert ordered(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == ordered(want)


def test_stage_keeps_columns_and_untouched_texts(spark):
    rows = odd_documents()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOCUMENTS + ", n_words int")
    got = without_repeats(docs)
    assert got.schema.names == docs.schema.names and got.count() == len(rows)
    want = {(d, n): kept for (d, _, gone, kept), n in zip(repeats(rows), range(len(rows)), strict=True) if gone}
    for r in got.collect():
        if (r["doc_id"], r["n_words"]) in want:
            assert r["text"] == want[r["doc_id"], r["n_words"]] and r["n_chars"] == len(r["text"])
        else:
            assert tuple(r)[:5] == rows[r["n_words"]]


def test_empty_table_and_clash(spark):
    assert substring_dedup(spark.createDataFrame([], DOCUMENTS)).count() == 0
    rows = odd_documents()
    got = substring_dedup(spark.createDataFrame([(*r, "x", -1) for r in rows], DOCUMENTS + ", Kept_Text string, n_removed int"))
    assert ordered(got.select("doc_id", "n_removed").collect()) == ordered((d, n) for d, _, n, _ in repeats(rows))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"]


def test_windows_leave_a_few_buckets_at_a_time():
    """A flush of a million windows stood in a worker several times over; it goes out in batches of some buckets."""
    rng = random.Random(3)
    texts = [prose(rng, 400, 5000) for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts * 2)], ["doc_id", "text"])
    out = list(tidy(op1._hash_windows(20, 200, 8))(iter([batch])))
    assert len(out) > 3 and max(b.num_rows for b in out) <= op1._FLUSH_BUCKETS
    rows = [r for b in out for r in b.to_pylist()]
    entries = [r["part"] for r in rows if r["kind"] == op1._ENTRIES]
    assert len(entries) == len(set(entries)) > 190
    seen = [len(op1._unpack([r["body"]], np.uint64 if r["kind"] == op1._ENTRIES else np.uint32)[0]) for r in rows]
    assert sum(seen) == 20 * 381
    assert sum(n for n, r in zip(seen, rows, strict=True) if r["kind"] == op1._REPEATS) == 10 * 381
