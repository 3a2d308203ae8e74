import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from helpers import listings, table
from parcelflow.plans import cycles, history, state

NOW = "2024-01-12 00:00:00"


def upsert(spark, stored, incoming):
    s = listings(spark, stored)
    i = listings(spark, incoming).drop("status", "seen_at")
    snapshot, events = state.upsert(s, i, NOW, preserve_sources=("offer_page",))
    return snapshot, events


def test_new_known_and_relisted(spark):
    snapshot, events = upsert(
        spark,
        [{"id": "a", "source_id": "A", "price_usd": 100000.0, "duplicate_group_key": "ka", "floor": 3},
         {"id": "b", "source_id": "B", "price_usd": 50000.0, "duplicate_group_key": "kb", "status": "removed", "area_m2": 40.0},
         {"id": "c", "source_id": "C", "price_usd": 70000.0, "duplicate_group_key": "kc", "area_m2": 70.0,
          "seen_at": dt.datetime(2024, 1, 2)}],
        [{"id": "x1", "source_id": "A", "price_usd": 98000.0, "duplicate_group_key": "ka", "floor": None},
         {"id": "x2", "source_id": "B", "price_usd": 50000.0, "duplicate_group_key": "kb", "area_m2": 40.0},
         {"id": "x3", "source_id": "N", "price_usd": 30000.0, "duplicate_group_key": "kn", "area_m2": 30.0}])
    assert table(events, "listing_id", "event_type", "old_price_usd", "new_price_usd") == [
        ("a", "price_changed", 100000.0, 98000.0), ("b", "relisted", None, None), ("x3", "first_seen", None, 30000.0)]
    got = {r.id: r for r in snapshot.collect()}
    assert sorted(got) == ["a", "b", "c", "x3"]
    assert (got["a"].price_usd, got["a"].floor, got["b"].status, got["c"].price_usd) == (98000.0, None, "active", 70000.0)
    assert got["c"].seen_at == dt.datetime(2024, 1, 2) and got["a"].seen_at == dt.datetime(2024, 1, 12)


def test_duplicate_overwrites_only_when_cheaper(spark):
    old = [{"id": "a", "source_id": "A", "price_usd": 100000.0, "duplicate_group_key": "k", "floor": None, "title": "old"}]
    snapshot, events = upsert(spark, old, [{"id": "x", "source_id": "X", "price_usd": 101000.0, "duplicate_group_key": "k", "floor": 7, "title": "new"}])
    assert table(snapshot, "id", "source_id", "price_usd", "title", "floor") == [("a", "A", 100000.0, "old", 7)]
    assert events.count() == 0
    snapshot, events = upsert(spark, old, [{"id": "x", "source_id": "X", "price_usd": 97000.0, "duplicate_group_key": "other", "title": "new"}])
    assert table(snapshot, "id", "source_id", "price_usd", "title") == [("a", "X", 97000.0, "new")]
    assert table(events, "event_type") == [("price_changed",)]


def test_sale_and_rent_never_merge(spark):
    snapshot, _ = upsert(spark, [{"id": "a", "source_id": "A", "price_usd": 5000.0, "duplicate_group_key": "k"}],
                         [{"id": "x", "source_id": "X", "price_usd": 4900.0, "duplicate_group_key": "k", "deal_type": "rent"}])
    assert snapshot.count() == 2


def test_confirmed_price_and_known_flags_survive(spark):
    snapshot, events = upsert(
        spark,
        [{"id": "a", "source": "offer_page", "source_id": "A", "price_usd": 100000.0, "duplicate_group_key": "k",
          "is_business": True, "seller_type": "agent"}],
        [{"id": "x", "source": "offer_page", "source_id": "A", "price_usd": 95000.0, "currency": "UZS", "duplicate_group_key": "k",
          "is_business": None, "seller_type": None}])
    assert table(snapshot, "price_usd", "currency", "is_business", "seller_type") == [(100000.0, "USD", True, "agent")]
    assert events.count() == 0


def test_exact_point_beats_approximate(spark):
    point = {"source_id": "A", "price_usd": 6e4, "duplicate_group_key": "k"}
    stored = [{"id": "a", **point, "lat": 1.0, "lng": 1.0, "coords_precision": "approx"}]
    snapshot, _ = upsert(spark, stored, [{"id": "x", **point, "lat": 2.0, "lng": 2.0, "coords_precision": "exact"}])
    assert table(snapshot, "lat", "coords_precision") == [(2.0, "exact")]
    stored[0].update(lat=2.0, lng=2.0, coords_precision="exact")
    for other in ({"lat": 3.0, "lng": 3.0, "coords_precision": "approx"}, {}):
        snapshot, _ = upsert(spark, stored, [{"id": "x", **point, **other}])
        assert table(snapshot, "lat", "coords_precision") == [(2.0, "exact")]


def test_probes(spark):
    rows = listings(spark, [
        {"id": "gone", "url": "g", "price_usd": 6e4}, {"id": "fix", "url": "f", "price_usd": 100000.0, "currency": "UZS", "floor": None},
        {"id": "same", "url": "s", "price_usd": 100000.0, "photos": ["own"]}])
    probes = spark.createDataFrame(
        [("g", True, [], None, None, None), ("f", False, ["p"], 95000.0, 4, 9), ("s", False, ["p"], 100500.0, 1, 9)],
        "url string, is_gone boolean, photos array<string>, usd_price double, floor int, total_floors int")
    marked, events = state.apply_probes(rows, probes, NOW)
    assert table(marked, "id", "status", "price_usd", "currency", "floor", "photos") == [
        ("fix", "active", 95000.0, "USD", 4, ["p"]), ("gone", "removed", 60000.0, "USD", 5, []),
        ("same", "active", 100000.0, "USD", 5, ["own"])]
    assert table(events, "listing_id", "event_type") == [("fix", "price_changed"), ("gone", "delisted")]


def test_needs_probe_and_gate(spark):
    stored = listings(spark, [{"source_id": s, "price_usd": 100000.0} for s in "ABC"])
    incoming = listings(spark, [{"source_id": s, "price_usd": p, "currency": "UZS"} for s, p in (("A", 95000.0), ("B", 80000.0), ("C", 103000.0))])
    assert table(state.needs_probe(incoming, stored), "source_id") == [("B",), ("C",)]
    kept, rejected = state.gate(listings(spark, [{"price_usd": 6e4}, {"price_usd": 10.0}, {"price_usd": 60.0, "deal_type": "rent"}]))
    assert kept.count() == 2 and table(rejected, "deal_type", "rejected") == [("sale", 1)]


def test_cycle(spark):
    stored = listings(spark, [{"id": "a", "source_id": "A", "price_usd": 6e4, "duplicate_group_key": "k", "seen_at": dt.datetime(2024, 1, 1)}])
    incoming = listings(spark, [{"id": "x", "source_id": "X", "price_usd": 9e4, "duplicate_group_key": "x", "area_m2": 60.0, "seller_id": "s"},
                                {"id": "y", "source_id": "Y", "price_usd": 1.0}]).drop("status", "seen_at")
    out = state.ingest_cycle(stored, incoming, NOW)
    assert table(out["listings"], "id", "status", "seller_type") == [("a", "removed", None), ("x", "active", "owner")]
    assert table(out["runs"], "found", "new_count", "rejected") == [(1, 1, 1)]
    assert table(out["delisted"], "listing_key") == [("a",)]


def test_hot_listing_timeline_is_split_but_whole(spark):
    """One key with most rows: bucketed lag equals a plain window."""
    from pyspark.sql import Window

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("listing_key"), F.col("id").cast("string").alias("id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, (id * 7919) % 5000)").alias("seen_at"),
        (F.col("id") % 97).cast("double").alias("price_usd"))
    got = history.sightings_with_previous(rows)
    plain = rows.withColumn("p", F.lag("price_usd").over(Window.partitionBy("listing_key").orderBy("seen_at", "id")))
    assert table(got, "id", "prev.price_usd") == table(plain, "id", "p")


def test_confirmed_price_outlives_a_cheaper_repost(spark):
    snapshot, events = upsert(
        spark, [{"id": "a", "source": "offer_page", "source_id": "A", "price_usd": 100000.0, "duplicate_group_key": "k"}],
        [{"id": "x", "source": "offer_page", "source_id": "X", "price_usd": 95000.0, "currency": "UZS", "duplicate_group_key": "k", "title": "new"}])
    assert table(snapshot, "id", "source_id", "title", "price_usd", "currency") == [("a", "X", "new", 100000.0, "USD")]
    assert events.count() == 0


def test_new_rows_of_one_flat_become_one_listing(spark):
    new = [{"id": "x", "source_id": "X", "price_usd": 95000.0, "duplicate_group_key": "k1"},
           {"id": "y", "source_id": "Y", "price_usd": 96000.0, "duplicate_group_key": "k2"},
           {"id": "z", "source_id": "Z", "price_usd": 96000.0, "duplicate_group_key": "k2", "floor": 8, "district": "E"}]
    snapshot, events = upsert(spark, [], new)
    assert table(snapshot, "id", "price_usd") == [("x", 95000.0)]
    assert table(events, "listing_id", "event_type") == [("x", "first_seen")]


def test_rows_without_fingerprint_stay_apart(spark):
    new = [{"id": "x", "source_id": "X", "price_usd": 95000.0, "duplicate_group_key": None, "district": "D"},
           {"id": "y", "source_id": "Y", "price_usd": 95000.0, "duplicate_group_key": None, "district": "E"}]
    snapshot, _ = upsert(spark, [], new)
    assert table(snapshot, "id") == [("x",), ("y",)]


def test_reposts_add_their_urls(spark):
    stored = listings(spark, [{"id": "a", "source_id": "A", "price_usd": 1e5, "duplicate_group_key": "k", "url": "u1"}])
    incoming = listings(spark, [{"id": "x", "source_id": "X", "price_usd": 1.2e5, "duplicate_group_key": "k", "url": "u2"}]).drop("status", "seen_at")
    links = state.source_url_rows(stored.select(F.col("id").alias("listing_id"), "source", "url"), state.route(stored, incoming))
    assert table(links, "listing_id", "url") == [("a", "u1"), ("a", "u2")]
    assert table(state.with_duplicate_count(stored, links), "id", "duplicate_count") == [("a", 2)]


def test_hot_key_of_one_day_is_cut(spark):
    """Half of all rows are one key's on one day; no stretch of a key holds more than its partition's share."""
    from parcelflow.operators.previous import stretches, with_previous

    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("listing_key"),
                                      F.col("id").cast("string").alias("id"), F.pmod(F.hash("id"), F.lit(86_400)).alias("at"))
    cut = stretches(rows, ["listing_key"], ["at", "id"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert cut.groupBy("listing_key", "__bucket").count().agg(F.max("count")).first()[0] < 2 * 40_000 / parts
    assert cut.where("listing_key = 'hot'").select("__bucket").distinct().count() > 1
    got = with_previous(rows, ["listing_key"], ["at", "id"], ["at", "id"])
    want = rows.withColumn("prev", F.lag(F.struct("at", "id")).over(Window.partitionBy("listing_key").orderBy("at", "id")))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_fingerprint_stays_what_it_was(spark):
    """A known row's new fingerprint does not replace the listing's; a later repost at the first price finds it by the old one."""
    stored = listings(spark, [{"id": "a", "source_id": "A", "price_usd": 50000.0, "duplicate_group_key": "old"}])
    known = listings(spark, [{"id": "x", "source_id": "A", "price_usd": 60000.0, "duplicate_group_key": "new"}]).drop("status", "seen_at")
    snapshot, _ = state.upsert(stored, known, "2024-01-12")
    assert table(snapshot, "id", "price_usd", "duplicate_group_key") == [("a", 60000.0, "old")]
    repost = listings(spark, [{"id": "y", "source_id": "B", "price_usd": 50000.0, "duplicate_group_key": "old"}]).drop("status", "seen_at")
    again, events = state.upsert(snapshot, repost, "2024-01-13")
    assert table(again, "id", "price_usd", "duplicate_group_key") == [("a", 50000.0, "old")]
    assert table(events, "listing_id", "event_type") == [("a", "price_changed")]


def test_replayed_and_broken_cycles_leave_one_result(spark, tmp_path):
    out = str(tmp_path / "cycles")
    stored = listings(spark, [{"id": "a", "source_id": "A", "price_usd": 60000.0, "district": "E"}])
    batch = listings(spark, [{"id": "x", "source_id": "X", "price_usd": 70000.0}, {"id": "low", "source_id": "L", "price_usd": 1.0}])
    other = listings(spark, [{"id": "y", "source_id": "Y", "price_usd": 90000.0, "district": "F"}])
    batch, other = batch.drop("status", "seen_at"), other.drop("status", "seen_at")
    cycles.begin(stored, out)
    assert cycles.run_cycle(batch, NOW, 1, out)
    before = table(cycles.current_listings(spark, out), "id", "status", "price_usd")
    # a repeated start and a repeated cycle change nothing, whatever they bring
    cycles.begin(other, out)
    assert not cycles.run_cycle(other, NOW, 1, out)
    # the next cycle stopped before its manifest row: nobody sees it, and the next attempt replaces it
    other.write.parquet(f"{out}/listings/cycle=2")
    other.write.parquet(f"{out}/runs/cycle=2")
    assert table(cycles.current_listings(spark, out), "id", "status", "price_usd") == before
    assert table(cycles.log(spark, out, "runs"), "cycle", "found", "new_count", "rejected") == [(1, 1, 1, 1)]
    assert cycles.run_cycle(other, NOW, 2, out)
    assert [r[0] for r in table(cycles.current_listings(spark, out), "id")] == ["a", "x", "y"]
    assert table(cycles.log(spark, out, "runs"), "cycle", "new_count") == [(1, 1), (2, 1)]
    assert table(cycles.log(spark, out, "events").where("event_type = 'first_seen'"), "cycle", "listing_id") == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        cycles.run_cycle(other, NOW, -1, out)


def _sighted(spark):
    rows = [{"id": str(i), "price_usd": 100000.0 - 9000 * i, "seen_at": dt.datetime(1998, 12, 1 + 20 * i)} for i in range(2)]
    later = [{"id": "2", "price_usd": 70000.0, "seen_at": dt.datetime(1999, 1, 5)}, {"id": "3", "price_usd": 1.0, "seen_at": None}]
    return listings(spark, rows + later).withColumn("listing_key", F.lit("flat"))


def test_events_deal_only_their_columns(spark, monkeypatch):
    from parcelflow.operators import previous
    from parcelflow.queries import history as queries

    written, write = {}, previous.materialise
    monkeypatch.setattr(previous, "materialise", lambda df, label: (written.update({label: df.columns}), write(df, label))[1])
    monkeypatch.setattr(queries, "sightings", lambda spark, sf_dir: _sighted(spark).where("seen_at IS NOT NULL"))
    out = queries.listing_events(spark, "")
    assert table(out, "event_type", "new_price_usd") == [
        ("first_seen", 100000.0), ("price_changed", 70000.0), ("price_changed", 91000.0), ("relisted", None), ("relisted", None)]
    assert sorted(written["stretches"]) == ["__bucket", "id", "listing_key", "price_usd", "seen_at"]


def test_upsert_sides_come_from_one_pass(spark, monkeypatch):
    from parcelflow.queries import history as queries

    monkeypatch.setattr(queries, "sightings", lambda spark, sf_dir: _sighted(spark))
    out = queries.upsert_events(spark, "")
    assert table(out, "listing_id", "event_type") == [("flat", "price_changed"), ("flat", "relisted")]
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
