import json

from pyspark.sql import functions as F

from helpers import table
from parcelflow.functions import text as T
from parcelflow.plans import dictionary
from parcelflow.sources import payloads
from parcelflow.sources.schemas import PAYLOAD, struct_type


def landed(spark, layout, body, deal="sale"):
    text = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)
    return spark.createDataFrame([(layout, layout, deal, "p1", None, text)], struct_type(PAYLOAD))


def test_flat_api(spark):
    body = {"total": 3, "results": [
        {"id": 71, "description": "Дача у озера.", "price": 48500, "priceCurrency": "usd", "address": "переулок Сиреневый", "districtId": 4,
         "room": "3", "square": 81.5, "floor": 2, "floorTotal": 3, "media": [{"url": "https://pics.example/71a.png"}],
         "moderationStatus": "approved", "isActive": True, "upAt": "2019-02-28T23:59:01.5Z"},
        {"id": 72, "price": 310, "priceCurrency": "usd", "priceType": "sqm", "prices": {"usd": 12400, "uzs": 157480000}, "room": "studio",
         "square": 40, "districtId": 5, "isActive": True},
        {"id": 73, "price": 9, "room": "1", "square": 30, "isActive": False}]}
    places = spark.createDataFrame([(4, "Сергелийский район"), (5, "Алмазарский район")], "id int, name string")
    out = payloads.parse_payloads(landed(spark, "flat_api", body), locations=places)
    assert table(out, "source_id", "rooms", "area_m2", "price", "currency", "district", "floor", "photos") == [
        ("71", 3, 81.5, 48500.0, "USD", "Сергелийский район", 2, ["https://pics.example/71a.png"]),
        ("72", 1, 40.0, 12400.0, "USD", "Алмазарский район", None, [])]
    rent = {"results": [{"id": i, "price": 275, "priceCurrency": "usd", "room": "2", "square": 52, "pricePeriodUnit": unit,
                         "description": "есть мебель"} for i, unit in ((81, "day"), (82, "month"))]}
    out = payloads.parse_payloads(landed(spark, "flat_api", rent, "rent"))
    assert table(out, "source_id", "price_period", "is_furnished") == [("82", "month", True)]


def test_nested_api(spark):
    attributes = {"name": {"ru": "6-комнатная дача, 204,5 м², 1/2 этаж"}, "statusKey": "active", "price": {"usd": 96000, "uzs": 1219200000},
                  "currency": "usd", "description": {"ru": "Сад и колодец"}, "imageSets": [{"w600": "https://pics.example/n.png"}],
                  "publishedAt": "2020-12-31T08:00:00.000042-03:30"}
    address = {"data": {"attributes": {"fullAddress": {"ru": "город, Бектемирский район, улица Липовая, 9"}}}}
    user = {"data": {"relations": {"role": {"data": {"attributes": {"key": "owner"}}}}}}
    body = {"data": [{"id": "905", "attributes": attributes, "relations": {"address": address, "user": user}}]}
    out = payloads.parse_payloads(landed(spark, "nested_api", body))
    assert table(out, "source_id", "rooms", "area_m2", "floor", "total_floors", "price", "district", "seller_type", "photos") == [
        ("905", 6, 204.5, 1, 2, 96000.0, "Бектемирский район", "owner", ["https://pics.example/n.png"])]


def page_state(state):
    return f"<script>window.__PRERENDERED_STATE__ = {json.dumps(json.dumps(state))};</script>"


def test_offer_and_card_of_one_advert(spark):
    url, title = "https://board.example/d/dacha-u-ozera-IDq9Zt2.html", "Учтепа 4/2/3 92м2 сад"
    offer = {"priceCurrency": "UZS", "areaServed": {"name": "Учтепинский район"}, "name": title, "price": 635000000, "url": url}
    ad = {"id": 31, "url": url, "photos": ["p1", "p2", "p3"], "user": {"id": 77}, "isBusiness": False, "map": {"lat": 41.5, "lon": 69.1},
          "params": [{"key": "furnished", "value": ["no"], "normalizedValue": "No"}]}
    product = json.dumps({"@type": "Product", "offers": {"offers": [offer]}}, ensure_ascii=False)
    html = (f'<html><script type="application/ld+json">{product}</script>'
            f'<div data-cy="l-card" id="500600"><a href="{url}"><h4>{title}</h4></a><p data-testid="ad-price">635 000 000 сум</p>'
            '<p data-testid="location-date">Ташкент, Учтепинский район — Вчера</p></div>'
            + page_state({"listing": {"listing": {"ads": [ad]}}}) + "</html>")
    out = payloads.parse_payloads(landed(spark, "offer_page", html, "rent"))
    assert table(out, "source_id", "rooms", "area_m2", "floor", "price", "district", "photos", "seller_id", "is_business", "lat",
                 "coords_precision", "is_furnished", "address_raw") == [
        ("q9Zt2", 4, 92.0, 2, 635000000.0, "Учтепинский район", ["p1", "p2", "p3"], "77", False, 41.5, "approx", False, "Учтепа сад")]


def test_cards(spark):
    def card(number, title, rest="", **data):
        marks = " ".join(f'data-{k}="{v}"' for k, v in {"id": f"k{number}", "url": f"https://cards.example/{number}", **data}.items())
        return f"<article data-listing {marks}><h2 data-title>{title}</h2>{rest}</article>"

    html = "<html><body>" + card(
        1, "дача   у  реки", '<p data-description>Сад.</p><img src="river.png">', price="317500000", currency="UZS", area="73.4", rooms="3",
        floor="1/2", district="Алмазарский район", address="Сиреневая, дом 7", seller="agency") + card(2, "без площади", price="5", area="", rooms="1")
    out = payloads.parse_payloads(landed(spark, "cards", html + "</body></html>"))
    assert table(out, "source_id", "url", "title", "price", "currency", "area_m2", "floor", "total_floors", "district", "photos", "seller_type") == [
        ("k1", "https://cards.example/1", "дача у реки", 317500000.0, "UZS", 73.4, 1, 2, "Алмазарский район", ["river.png"], "agency")]


def test_detail_probes(spark):
    def page(**ad):
        return page_state({"ad": {"ad": ad}})

    alive = page(status="active", isActive=True, photos=[f"{i}.png" for i in range(9)], params=[{"key": "floor", "value": "11"}],
                 price={"regularPrice": {"value": 52500, "currencyCode": "UYE"}})
    rows = [("alive", 200, alive), ("expired", 200, page(status="outdated", isActive=False)),
            ("gone", 410, ""), ("plain", 200, "<p>maintenance</p>"), ("withdrawn", 200, page(status="removed_by_user", isActive=False))]
    out = payloads.detail_probes(spark.createDataFrame(rows, "url string, status_code int, html string"))
    assert table(out, "url", "is_gone", F.size("photos"), "usd_price", "floor") == [
        ("alive", False, 5, 52500.0, 11), ("expired", True, 0, None, None), ("gone", True, 0, None, None),
        ("plain", False, 0, None, None), ("withdrawn", True, 0, None, None)]


def test_dictionary_merge_is_idempotent(spark):
    d = spark.createDataFrame([(1, "Maple Row", "k1", "D"), (2, "Maple Row вид", "k2", "D"), (3, "Олма Сити", "k3", "D"), (4, "Olma City", "k4", "D"),
                               (5, "СРОЧНО", "k5", "D")], "id long, name string, match_key string, district string")
    rows = spark.createDataFrame([(str(i), c, "active") for i, c in enumerate((1, 2, 2, 3, 4, 5))],
                                 "id string, residential_complex_id long, status string")
    once = dictionary.merge_complexes(d, rows)
    r = once["report"].first()
    assert (r.merge_groups, r.rows_deleted, r.orphans_dropped, r.complexes_after, r.orphan_listings_nulled) == (2, 2, 1, 2, 1)
    assert table(once["dictionary"], "id", "match_key") == [(2, "maplerow"), (3, "olmacity")]
    twice = dictionary.merge_complexes(once["dictionary"], once["listings"])
    r = twice["report"].first()
    assert (r.merge_groups, r.rows_deleted, r.rows_rekeyed, r.complexes_after) == (0, 0, 0, 2)


def test_backfill_gets_or_creates(spark):
    d = spark.createDataFrame([(1, "Maple Row", "maplerow", "D")], "id long, name string, match_key string, district string")
    rows = spark.createDataFrame(
        [("a", "D", "в ЖК Maple Row", None), ("b", "D", "ж/к Olma City", None), ("c", "D", "ЖК Олма Сити", None), ("d", "D", "дом", None)],
        "id string, district string, address_raw string, residential_complex_id long").withColumn("description", F.lit(None).cast("string"))
    grown, updated, report = dictionary.backfill(rows, d)
    ids = dict(table(updated, "id", "residential_complex_id"))
    assert ids["a"] == 1 and ids["b"] == ids["c"] not in (None, 1) and ids["d"] is None
    assert grown.count() == 2 and tuple(report.first()) == (4, 3)


def test_extractions_run_once(spark):
    """A filter on extracted columns must not repeat the extraction, nor a test for an empty text."""
    for layout, body, mark in (("nested_api", "{}", T.AREA_IN_TITLE), ("cards", "", "data-area")):
        out = payloads.parse_payloads(landed(spark, layout, body), layouts=[layout]).select("source_id", "price", "area_m2", "rooms")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # an attribute of a card may stand in the tag or in a child
        assert 1 <= plan.count(mark) <= (2 if layout == "cards" else 1), layout
    texts = spark.createDataFrame([("",), ("x",), (None,)], "t string")
    assert [r[0] for r in texts.select(payloads._blank(F.col("t"))).collect()] == [None, "x", None]
