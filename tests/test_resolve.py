import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import listings, table
from parcelflow.operators.pivot_clusters import pivot_clusters
from parcelflow.plans import resolve


def merge(spark, rows, **kw):
    return resolve.merge_duplicates(listings(spark, rows), **kw)


def test_exact_copies(spark):
    got = merge(spark, [{"price_usd": 6e4, "seen_at": dt.datetime(2024, 1, d)} for d in (1, 5)] + [{"price_usd": 9e4}])
    assert table(got["links"], "id", "canonical_id", "pass") == [("1", "2", 1)]
    assert table(got["report"], "pass", "merged_groups", "deleted_rows") == [(1, 1, 1)]
    got = merge(spark, [{"price_usd": 6e4, "status": "removed", "seen_at": dt.datetime(2024, 2, 1)}, {"price_usd": 6e4}])
    assert table(got["survivors"], "id") == [("2",)]


def test_reposts_keep_the_cheapest(spark):
    got = merge(spark, [{"price_usd": p} for p in (99191.93, 99012.52, 100104.06)])
    assert table(got["survivors"], "id", "price_usd") == [("2", 99012.52)]
    assert got["report"].where("pass = 2").first()["deleted_rows"] == 2
    assert merge(spark, [{"price_usd": 80000.0}, {"price_usd": 100000.0}])["links"].count() == 0


def test_floors(spark):
    got = merge(spark, [{"price_usd": 60000.0 + i, "floor": f} for i, f in enumerate((None, 18, None))])
    assert table(got["survivors"], "id", "floor") == [("1", 18)]
    got = merge(spark, [{"price_usd": 60000.0 + i, "floor": f} for i, f in enumerate((3, 9))])
    assert got["links"].count() == 0
    got = merge(spark, [{"price_usd": 60000.0 + i, "floor": f} for i, f in enumerate((3, 9, None, None))])
    assert table(got["links"], "id", "canonical_id") == [("4", "3")]


def test_links_follow_both_passes(spark):
    rows = [{"price_usd": 61000.0, "seen_at": dt.datetime(2024, 1, d)} for d in (1, 2)] + [{"price_usd": 60000.0}]
    got = merge(spark, rows)
    assert table(got["links"], "id", "canonical_id", "pass") == [("1", "3", 1), ("2", "3", 2)]


def pivots(prices, tolerance):
    out, pivot = {}, None
    for p in sorted(prices):
        if pivot is None or p > pivot * (1 + tolerance):
            pivot = p
        out[p] = pivot
    return out


def test_pivot_clusters(spark):
    rnd = random.Random(7)
    groups = {"a": [100.0, 104.0, 106.0, 109.0, 111.4, 120.0], "b": [rnd.uniform(50, 5000) for _ in range(200)], "c": [1.0, 1.0]}
    df = spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "g string, p double")
    got = {(r.g, r.p): r.pivot for r in pivot_clusters(df, ["g"], "p", 0.05).collect()}
    assert got == {(g, p): v for g, ps in groups.items() for p, v in pivots(ps, 0.05).items()}


def test_fingerprint_scope(spark):
    rows = listings(spark, [{"price_usd": 5000.0}, {"price_usd": 4400.0, "deal_type": "rent"}, {"price_usd": 5010.0}])
    rows = rows.withColumn("print", resolve.fingerprint(*[F.col(c) for c in ("district", "address_raw", "rooms", "area_m2", "price_usd")]))
    assert table(resolve.first_duplicate(rows, keys=["deal_type", "print"]), "id", "duplicate_id") == [("1", "3"), ("3", "1")]


def test_same_flat_floor_wildcard(spark):
    stored = listings(spark, [{"id": "k3", "price_usd": 100000.0, "floor": 3}, {"id": "k0", "price_usd": 102000.0, "floor": None}])
    incoming = listings(spark, [{"id": "n4", "price_usd": 100500.0, "floor": 4}, {"id": "n", "price_usd": 100500.0, "floor": None},
                                {"id": "far", "price_usd": 120000.0, "floor": 3}])
    assert table(resolve.same_flat(incoming, stored), "id", "duplicate_id") == [("n", "k3"), ("n4", "k0")]


def test_source_links(spark):
    rows = listings(spark, [{"price_usd": 1e5, "url": u} for u in ("a", "b", "a")])
    links = spark.createDataFrame([("1", "1"), ("2", "1"), ("3", "1")], "id string, canonical_id string")
    out = resolve.duplicate_counts(resolve.source_links(rows, links))
    assert table(out, "canonical_id", "duplicate_count") == [("1", 2)]


def test_groups_travel_under_short_keys(spark, monkeypatch):
    """A pass carries no column but the ones it ranks and fills by, and a group's key is 16 bytes."""
    from parcelflow.operators import pivot_clusters as P

    written = {}
    for module in (resolve, P):
        def keep(df, label, write=module.materialise):
            written.setdefault(label, df.columns)
            return write(df, label)
        monkeypatch.setattr(module, "materialise", keep)
    got = merge(spark, [{"price_usd": p} for p in (99191.93, 99012.52, 100104.06)])
    assert table(got["links"], "id", "canonical_id", "pass") == [("1", "2", 2), ("3", "2", 2)]
    assert written["cluster-values"] == ["__group", "__v"]
    assert not {"title", "description", "district"} & set(written["clustered"] + written["floor-groups"])


def test_first_duplicate_reads_its_rows_once(spark):
    rows = listings(spark, [{"price_usd": 5000.0}, {"price_usd": 5000.0}, {"price_usd": 5000.0, "rooms": None}, {"price_usd": 6000.0, "rooms": None}])
    out = resolve.first_duplicate(rows, keys=["deal_type", "rooms"])
    assert table(out, "id", "duplicate_id") == [("1", "2"), ("2", "1"), ("3", "4"), ("4", "3")]
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_source_links_read_their_rows_once(spark, monkeypatch):
    from parcelflow.queries import resolve as queries

    offered = [{"price_usd": 50000.0, "seller_id": "7"}, {"price_usd": 50000.0, "seller_id": "8"}, {"price_usd": 50000.0, "seller_id": "7", "rooms": None}]
    monkeypatch.setattr(queries, "listings", lambda spark, sf_dir: listings(spark, offered))
    out = queries.source_link_rows(spark, "")
    assert table(out, "canonical_id", "url", "best_id") == [("1", "7", "1"), ("1", "8", "2"), ("3", "7", "3")]
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
