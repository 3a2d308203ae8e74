import datetime as dt
import uuid

from pyspark.sql import functions as F

from helpers import listings, table
from parcelflow.plans import history
from parcelflow.sources.storage import shared_dir
from parcelflow.streaming import jobs


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def land(df, path, parts):
    """Each part becomes one file, in order of arrival."""
    for i, cond in enumerate(parts):
        df.where(cond).coalesce(1).write.mode("append").parquet(path)


def test_events_equal_batch_across_batches(spark):
    rows = [("a", i, dt.datetime(2024, 1, d), p) for i, (d, p) in enumerate([(1, 100.0), (2, 98.0), (9, 97.5), (10, 90.0)])]
    rows += [("b", 10, dt.datetime(2024, 1, 3), 50.0), ("b", 11, dt.datetime(2024, 1, 9), 60.0)]
    df = spark.createDataFrame([(k, str(i), at, p) for k, i, at, p in rows], "listing_key string, id string, seen_at timestamp_ntz, price_usd double")
    path = folder(spark, "sightings")
    land(df, path, ["seen_at < '2024-01-05'", "seen_at >= '2024-01-05'"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.listing_events(stream, folder(spark, "out"), days=30)
    want = history.listing_events(history.sightings_with_previous(df))
    cols = ["listing_key", "event_type", "old_price_usd", "new_price_usd", "gap_days"]
    assert table(got, *cols) == table(want, *cols)


def test_unseen_listing_times_out(spark):
    df = spark.createDataFrame([("a", "1", dt.datetime(2024, 1, 1), 10.0), ("b", "2", dt.datetime(2024, 1, 20), 10.0), ("b", "3", dt.datetime(2024, 1, 21), 10.0)],
                               "listing_key string, id string, seen_at timestamp_ntz, price_usd double")
    path = folder(spark, "sightings")
    land(df, path, ["id = '1'", "id = '2'", "id = '3'"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.listing_events(stream, folder(spark, "out"))
    assert table(got.where("event_type = 'delisted'"), "listing_key", "old_price_usd") == [("a", 10.0)]


def test_delisted_once_and_back(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [("a", "1", at(1), 10.0, 0), ("b", "2", at(9), 20.0, 0), ("b", "3", at(10), 20.0, 1), ("c", "4", at(10), 5.0, 1),
            ("a", "5", at(12), 8.0, 2), ("c", "6", at(9, 20), 4.0, 2), ("d", "7", at(13), 1.0, 2), ("b", "8", at(14), 20.0, 3)]
    df = spark.createDataFrame(rows, "listing_key string, id string, seen_at timestamp_ntz, price_usd double, nth int")
    path, out = folder(spark, "sightings"), folder(spark, "out")
    for i in range(4):  # each drain is a restart
        df.where(f"nth = {i}").drop("nth").coalesce(1).write.mode("append").parquet(path)
        got = jobs.listing_events(spark.readStream.schema(df.drop("nth").schema).parquet(path), out, days=3)
    cols = ["listing_key", "event_type", "at", "old_price_usd", "new_price_usd", "old_status", "gap_days"]
    assert table(got, *cols) == sorted([
        ("a", "first_seen", at(1), None, 10.0, None, None), ("a", "delisted", at(9), 10.0, None, "active", None),
        ("a", "relisted", at(12), None, None, "removed", 11), ("a", "price_changed", at(12), 10.0, 8.0, None, None),
        ("b", "first_seen", at(9), None, 20.0, None, None), ("b", "relisted", at(14), None, None, "active", 4),
        ("c", "first_seen", at(10), None, 5.0, None, None), ("c", "late", at(9, 20), None, 4.0, None, None), ("c", "delisted", at(14), 5.0, None, "active", None),
        ("d", "first_seen", at(13), None, 1.0, None, None)], key=repr)


def test_alert_consumer_sends_once(spark):
    rows = listings(spark, [{"id": i, "source_id": i, "price_usd": 60000.0, "status": s} for i, s in (("a", "active"), ("b", "active"), ("c", "removed"), ("old", "active"))]).withColumns(
        {"discount_percent": F.lit(20.0), "commission_pct": F.lit(0.0)})
    alerts = spark.createDataFrame([(1, 7, "sale", 10.0, True), (2, 7, "sale", 5.0, True), (3, 8, "sale", 30.0, True), (4, 9, "sale", None, True), (5, 9, "sale", None, False)],
                                   "id int, user_id int, deal_type string, discount_min double, is_active boolean").withColumns({
        "districts": F.array().cast("array<string>"), "rooms": F.array().cast("array<int>"), "sources": F.array().cast("array<string>"),
        "no_commission": F.lit(False), **{f"{b}_{e}": F.lit(None).cast("double") for b in ("price", "ppm", "area", "floor") for e in ("min", "max")}})
    at = lambda d: dt.datetime(2024, 1, d)
    schema = "listing_key string, event_type string, at timestamp_ntz"
    parts = [[("old", "first_seen", at(1))],
             [("a", "first_seen", at(2)), ("b", "price_changed", at(2)), ("c", "first_seen", at(2))],
             [("a", "first_seen", at(3)), ("b", "first_seen", at(3))], [("a", "first_seen", at(4)), ("old", "first_seen", at(1))]]
    path, out = folder(spark, "events"), folder(spark, "sends")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        landed = spark.read.schema(schema).parquet(path)
        log = jobs.notify(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), rows, alerts, "2024-01-05", out, backlog=landed)
        if part is parts[1]:
            assert table(log, "user_id", "listing_id") == [(7, "a"), (9, "a")]
    assert table(log, "user_id", "listing_id", "alert_id") == [(7, "a", 1), (7, "b", 1), (9, "a", 4), (9, "b", 4)]
    # a replayed batch leaves the same log
    assert log.where("batch_id >= 0").select("batch_id").distinct().count() == 2


def test_daily_activity_once_across_batches(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, h)) for h in (1, 5, 20)] + [(2, dt.datetime(2024, 1, 1, 3)), (1, dt.datetime(2024, 1, 2, 1))],
                               "user_id long, ts timestamp")
    path = folder(spark, "events")
    land(df, path, ["hour(ts) < 4", "hour(ts) >= 4"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.run_to_files(jobs.daily_activity(stream), folder(spark, "out"))
    assert got.count() == got.distinct().count() == 3


def test_first_human_click(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 1), "TelegramBot"), (1, dt.datetime(2024, 1, 1, 2), "Mozilla"),
                                (1, dt.datetime(2024, 1, 1, 3), "Mozilla")], "send_id long, ts timestamp, user_agent string")
    path = folder(spark, "clicks")
    land(df, path, ["hour(ts) <= 2", "hour(ts) = 3"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.run_to_files(jobs.first_clicks(stream), folder(spark, "out"))
    assert table(got, "send_id", F.hour("clicked_at")) == [(1, 2)]


def test_snapshots_move_batch_by_batch(spark):
    stored = listings(spark, [{"id": "a", "source_id": "A", "price_usd": 100000.0, "duplicate_group_key": "ka"}])
    incoming = listings(spark, [{"id": "x", "source_id": "A", "price_usd": 90000.0, "duplicate_group_key": "ka"},
                                {"id": "y", "source_id": "N", "price_usd": 30000.0, "duplicate_group_key": "kn", "area_m2": 30.0}]).drop("status", "seen_at")
    path = folder(spark, "incoming")
    land(incoming, path, ["id = 'x'", "id = 'y'"])
    stream = spark.readStream.schema(incoming.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = folder(spark, "out")
    got = jobs.upsert_snapshots(stream, stored, out, dt.datetime(2024, 1, 12))
    assert table(got, "id", "price_usd") == [("a", 90000.0), ("y", 30000.0)]
    events = spark.read.parquet(f"{out}/events")
    assert table(events, "listing_id", "event_type") == [("a", "price_changed"), ("y", "first_seen")]
