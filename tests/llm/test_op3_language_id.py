import pyarrow as pa
from plain import DOCUMENTS, odd_documents
from pyspark.sql import functions as F

from parcelflow.llm.op3_language_id import Alphabet, grams, keep_languages, learn_profiles, predict_language
from parcelflow.llm.queries import QUERIES


def _gram(code):
    return "".join(chr(code >> s & 0x1FFFFF) for s in (0, 21, 42) if code >> s & 0x1FFFFF)


def _plain_grams(text):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
    out = []
    for w in words:
        padded = f" {w} "
        out += list(w) + [padded[i:i + 2] for i in range(len(padded) - 1)] + [padded[i:i + 3] for i in range(len(padded) - 2)]
    return sorted(out)


def test_grams():
    texts = [*[t for _, t, *_ in odd_documents()][:40], None, "", "É a-b", "1 2", "end", "x", "日本 語"]
    found, of = grams(pa.array(texts), Alphabet())
    for i, t in enumerate(texts):
        assert sorted(_gram(int(g)) for g in found[of == i]) == _plain_grams(t)


def test_distance_of_small_profiles(spark):
    docs = spark.createDataFrame([(1, "aaab", "x", "s", 4), (2, "bbba", "y", "s", 4), (3, "zzz", None, "s", 3)], DOCUMENTS)
    profiles = learn_profiles(docs, size=2)
    assert [_gram(g) for g in profiles["x"]] == ["a", "aa"] and [_gram(g) for g in profiles["y"]] == ["b", "bb"]
    # places of the document: a 0, b 1; x has a at 0 and no b, y has b at 0 and no a
    got = predict_language(spark.createDataFrame([(9, "b a", None, None, 1), (10, "q", None, None, 1), (11, "1 2", None, None, 1), (12, None, None, None, None)],
                                                 DOCUMENTS), profiles, size=2, carry=["doc_id"]).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("x", 0.5 / 0.75), ("x", 0.0), ("und", 0.0), ("und", 0.0)]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op3_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 30 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_stage_and_odd_tables(spark):
    rows = odd_documents()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], DOCUMENTS + ", score double")
    got = keep_languages(docs)
    assert got.schema.names == docs.schema.names
    assert got.count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    assert got.filter(F.col("score") != 0.5).count() == 0
    assert keep_languages(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in predict_language(unlabelled.drop("score"), learn_profiles(unlabelled)).collect()} == {"und"}
    assert {r["score"] for r in predict_language(docs, {}).collect()} == {0.0}


def test_memory_of_a_batch_is_a_slice():
    import tracemalloc

    import pyarrow as pa
    from parcelflow.llm import op3_language_id as op3

    texts = ["the quick brown fox jumps over the lazy dog " * 6000] * 8
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 8, "text": texts})
    tracemalloc.start()
    counts = list(op3._training_counts(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[0].num_rows > 50
    assert peak < 100e6
