import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import listings, table
from parcelflow.plans import alerts, product, search
from parcelflow.sources.schemas import ALERT, conform, struct_type


def alert_table(spark, rows):
    base = dict(deal_type="sale", districts=[], rooms=[], sources=[], is_active=True)
    full = [{**base, "id": i, "user_id": i, **r} for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(x.get(n) for n in ALERT) for x in full], struct_type(ALERT))


def test_matching_rules(spark):
    rows = listings(spark, [{"id": "l", "price_usd": 50000.0, "district": "D", "rooms": 2, "floor": 5, "discount_percent": 12.0,
                             "commission_pct": None}])
    cases = [
        ({}, True), ({"districts": ["D", "E"]}, True), ({"districts": ["E"]}, False), ({"rooms": [1, 2]}, True), ({"rooms": [3]}, False),
        ({"sources": ["board"]}, True), ({"sources": ["x"]}, False), ({"price_max": 49999.0}, False), ({"price_min": 50000.0}, True),
        ({"floor_min": 6}, False), ({"discount_min": 12.0}, True), ({"discount_min": 12.5}, False), ({"deal_type": "rent"}, False),
        ({"no_commission": True}, False), ({"is_active": False}, False), ({"area_min": 100.0, "area_max": 100.0}, True),
    ]
    got = {r[0] for r in table(alerts.match_alerts(rows, alert_table(spark, [c for c, _ in cases])), "user_id")}
    assert got == {i for i, (_, ok) in enumerate(cases, 1) if ok}


def test_ranges_as_keys(spark):
    """All kinds of ranges against every pair, and few pairs met beyond the matching ones."""
    rnd = random.Random(3)
    rows = [{"price_usd": float(rnd.choice([6000, rnd.randint(5000, 200000)])), "area_m2": float(rnd.randint(20, 150)),
             "floor": rnd.choice([None, *range(1, 20)]), "rooms": rnd.choice([None, 1, 2, 3]), "district": rnd.choice([None, "D", "E"]),
             "source": rnd.choice(["board", "feed"]), "discount_percent": rnd.choice([None, *map(float, range(12))]),
             "commission_pct": rnd.choice([None, 0.0, 2.0])} for _ in range(300)]
    wishes = [{}, {"districts": None, "rooms": None, "sources": None}]
    for _ in range(150):
        wish = {"districts": rnd.choice([[], ["D"], ["D", "E", "E"]]), "rooms": rnd.choice([[], [1], [1, 3]]),
                "sources": rnd.choice([[], ["feed"]]), "no_commission": rnd.random() < 0.2}
        for bound, top in (("price", 200000), ("ppm", 3000), ("area", 150), ("floor", 20)):
            for end in ("min", "max"):
                if rnd.random() < 0.2:
                    at = rnd.randint(0, top)
                    wish[f"{bound}_{end}"] = at if bound == "floor" else float(at)
        if rnd.random() < 0.5:
            wish["discount_min"] = float(rnd.randint(0, 11))
        wishes.append(wish)

    def meets(wish, row):
        figures = {"price": row["price_usd"], "ppm": row["price_usd"] / row["area_m2"], "area": row["area_m2"], "floor": row["floor"] or 0}
        least = wish.get("discount_min")
        return (all(not wish.get(many) or row[one] in wish[many] for many, one in (("districts", "district"), ("rooms", "rooms"), ("sources", "source")))
                and all(wish.get(f"{b}_min", x) <= x <= wish.get(f"{b}_max", x) for b, x in figures.items())
                and (least is None or (row["discount_percent"] is not None and row["discount_percent"] >= least))
                and (not wish.get("no_commission") or row["commission_pct"] == 0))

    expected = {(i, str(j)) for i, w in enumerate(wishes, 1) for j, r in enumerate(rows, 1) if meets(w, r)}
    known, saved = listings(spark, rows), alert_table(spark, wishes)
    assert set(table(alerts.match_alerts(known, saved), "user_id", "listing_id")) == expected
    met = alerts.alert_candidates(known, saved)
    assert met.select("alert_id", "listing_id").distinct().count() == met.count() <= 5 * len(expected)


def test_no_listings_or_alerts(spark):
    rows, saved = listings(spark, [{"price_usd": 5e4}]), alert_table(spark, [{"price_max": 6e4}])
    assert table(alerts.match_alerts(rows, saved), "alert_id") == [(1,)]
    assert alerts.match_alerts(rows.limit(0), saved).count() == alerts.match_alerts(rows, saved.limit(0)).count() == 0


def test_commission_and_first_alert(spark):
    rows = listings(spark, [{"id": str(c), "price_usd": 5e4, "commission_pct": c} for c in (None, 0.0, 3.0)])
    a = alert_table(spark, [{"no_commission": True}])
    assert table(alerts.match_alerts(rows, a), "listing_id") == [("0.0",)]
    two = alert_table(spark, [{"id": 9, "user_id": 1}, {"id": 4, "user_id": 1, "districts": ["D"]}])
    assert table(alerts.match_alerts(rows.limit(1), two), "user_id", "alert_id") == [(1, 4)]


def test_first_alert_of_few_and_many(spark):
    """Users with one to twelve alerts, equal and missing ids, and listing ids that come more than once."""
    rnd = random.Random(7)
    rows = [{"id": str(i % 50), "price_usd": float(rnd.randint(5000, 90000)), "rooms": rnd.choice([1, 2, 3]), "district": rnd.choice(["D", "E"]),
             "discount_percent": rnd.choice([None, 3.0, 9.0]), "commission_pct": rnd.choice([None, 0.0])} for i in range(60)]
    wishes = [{"id": rnd.choice([None, 100 * user + k // 2]), "user_id": user or None, "rooms": rnd.choice([[], [1], [2, 3]]),
               "districts": rnd.choice([[], ["E"]]), "price_max": rnd.choice([None, 20000.0, 60000.0]),
               "discount_min": rnd.choice([None, 5.0]), "no_commission": rnd.random() < 0.2} for user in range(13) for k in range(user or 2)]
    first = {}
    for w in wishes:
        for r in rows:
            if ((not w["rooms"] or r["rooms"] in w["rooms"]) and (not w["districts"] or r["district"] in w["districts"])
                    and (w["price_max"] is None or r["price_usd"] <= w["price_max"])
                    and (w["discount_min"] is None or (r["discount_percent"] or 0) >= w["discount_min"])
                    and (not w["no_commission"] or r["commission_pct"] == 0)):
                pair = w["user_id"], r["id"]
                first[pair] = min((i for i in (first.get(pair), w["id"]) if i is not None), default=None)
    got = table(alerts.match_alerts(listings(spark, rows), alert_table(spark, wishes)), "user_id", "listing_id", "alert_id")
    assert got == sorted(((*pair, i) for pair, i in first.items()), key=repr)


def test_pairs_are_not_grouped(spark):
    """Pairs grow with users times listings: none of them is shuffled to find a user's first alert."""
    rows = listings(spark, [{"price_usd": 5e4 + i} for i in range(20)])
    saved = alert_table(spark, [{"id": i, "user_id": i % 4, "rooms": [2, i]} for i in range(12)])
    plan = alerts.match_alerts(rows, saved)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan


def test_csv_and_bots(spark):
    df = spark.createDataFrame([(" a, b ,,c", "2, x,3"), (None, None)], "t string, n string")
    assert [tuple(r) for r in df.select(alerts.csv_list(F.col("t")), alerts.csv_ints(F.col("n"))).collect()] == [
        (["a", "b", "c"], [2, 3]), ([], [])]
    ua = spark.createDataFrame([("Mozilla",), ("TelegramBot",), ("",), (None,)], "u string")
    assert [r[0] for r in ua.select(alerts.is_bot(F.col("u"))).collect()] == [False, True, True, True]


def test_source_health_order(spark):
    day = dt.datetime(2024, 1, 10)
    runs = [("ok", 1, "success", 3, day), ("empty", 2, "success", 0, day), ("err", 3, "success", 1, day),
            ("err", 4, "failed", 0, day + dt.timedelta(minutes=5)), ("old", 5, "success", 1, day - dt.timedelta(days=1)), ("down", 6, "failed", 0, day)]
    df = spark.createDataFrame([(s, i, st, n, 0, at, at) for s, i, st, n, at in runs],
                               "source string, id int, status string, new_count int, updated_count int, started_at timestamp_ntz, finished_at timestamp_ntz")
    got = dict(table(product.source_health(df, "2024-01-10 00:30:00"), "source", "health"))
    assert got == {"ok": "ok", "empty": "empty", "err": "error", "old": "stale", "down": "down"}


def test_buckets_add_up(spark):
    sends = spark.createDataFrame([(i, float(i % 45), dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 21) if i % 3 else None) for i in range(90)],
                                  "id int, discount_snapshot double, sent_at timestamp_ntz, clicked_at timestamp_ntz")
    per = alerts.ctr_by_bucket(sends, "2024-01-31 00:00:00")
    whole = alerts.ctr(sends, "2024-01-31 00:00:00", days=30).first()
    assert per.agg(F.sum("sends"), F.sum("clicks")).first() == (whole.sends, whole.clicks)
    assert per.count() == 4


def test_pages_concatenate_to_the_whole_order(spark):
    rows = listings(spark, [{"price_usd": 5e4 + i % 7, "discount_percent": None if i % 5 == 0 else float(i % 11)} for i in range(60)])
    for sort in ("discount", "price", "price_per_m2", "fresh"):
        order = search.order_for(sort)
        whole = [r.id for r in rows.orderBy(*order).collect()]
        pages = [r.id for o in range(0, 60, 25) for r in search.page(rows, order, limit=25, offset=o).collect()]
        assert pages == whole
    tail = [r.discount_percent for r in rows.orderBy(*search.order_for("discount")).collect()][-12:]
    assert tail == [None] * 12


def test_search_escapes_wildcards(spark):
    rows = listings(spark, [{"price_usd": 5e4, "title": "100% дом"}, {"price_usd": 5e4, "title": "1000 дом"}])
    got = search.search(rows, search.Filters(q="100% ДОМ"))
    assert table(got, "id") == [("1",)]


def test_conform(spark):
    out = conform(spark.createDataFrame([(1,)], "id int"), ALERT)
    assert out.columns == list(ALERT) and out.first().id == 1
