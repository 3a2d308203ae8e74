import zlib
from collections import Counter

import pytest
from plain import DOCUMENTS, odd_documents, ordered

from parcelflow.llm import op4_sharding
from parcelflow.llm.op4_sharding import external_shuffle, write_shards
from parcelflow.llm.queries import QUERIES


@pytest.mark.parametrize(("shards", "bucket_rows"), [(40, 8192), (7, 5), (3, 1)])
def test_every_record_once_in_even_shards(spark, shards, bucket_rows):
    rows = odd_documents()
    got = external_shuffle(spark.createDataFrame(rows, DOCUMENTS), shards=shards, bucket_rows=bucket_rows).collect()
    assert ordered(tuple(r)[:5] for r in got) == ordered(rows)
    slots = {}
    for r in got:
        assert r["law"] == "rows"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_same_again_and_mixed(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id")
    one, two = (external_shuffle(docs.repartition(n), shards=10, bucket_rows=100).collect() for n in (3, 5))
    assert ordered(one) == ordered(two)
    other = external_shuffle(docs, shards=10, bucket_rows=100, seed=5).collect()
    assert ordered(other) != ordered(one)
    # ids spread over the shards, and neighbours do not stay together
    by_third = Counter((r["shard"], r["doc_id"] // 1000) for r in one)
    assert min(by_third.values()) > 60
    place = {r["doc_id"]: (r["shard"], r["slot"]) for r in one}
    assert sum(place[i][0] == place[i + 1][0] for i in range(2999)) < 600


def test_query_columns(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op4_sharding"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        text = (d["text"] or "").encode()
        assert (got[d["doc_id"]]["size"], got[d["doc_id"]]["text_crc32"]) == (len(text) + 16, zlib.crc32(text))


def test_files_and_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame(odd_documents(), DOCUMENTS)
    write_shards(external_shuffle(docs, shards=4), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert ordered(tuple(r)[:5] for r in back.select(*docs.columns).collect()) == ordered(odd_documents())
    assert external_shuffle(docs.limit(0)).count() == 0
    clash = external_shuffle(docs.selectExpr("*", "-1 AS Slot", "1 AS __bucket"))
    assert clash.columns == [*docs.columns, "__bucket", "law", "shard", "slot"] and clash.filter("slot < 0").count() == 0


def test_whole_records_are_written_and_copies_share_no_bucket(spark, sf, monkeypatch):
    written = []
    monkeypatch.setattr(op4_sharding, "write_shards", lambda sharded, path: (written.append((sharded, path)), write_shards(sharded, path)))
    got = QUERIES["op4_sharding"](spark, sf)
    (sharded, path), docs = written[0], spark.read.parquet(f"{sf}/documents.parquet")
    back = spark.read.parquet(path)
    assert ordered(back.select(*docs.columns).collect()) == ordered(docs.collect())
    assert ordered(back.select("doc_id", "shard", "slot").collect()) == ordered(got.select("doc_id", "shard", "slot").collect())
    # the plan orders rows; it never gathers a bucket in one row
    assert "collect_list" not in sharded._jdf.queryExecution().toString()
    same = spark.range(4000).selectExpr("1 AS doc_id", "'x' AS text")
    other = spark.range(400).selectExpr("id + 2 AS doc_id", "'y' AS text")
    rows = external_shuffle(same.unionByName(other), shards=10, bucket_rows=100).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 4400
    assert all(20 <= n <= 60 for n in Counter(r["shard"] for r in rows if r["doc_id"] > 1).values())
