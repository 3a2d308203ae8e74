from pyspark.sql import functions as F

from helpers import listings, table
from parcelflow.operators.quantiles import grouped_median, grouped_medians, grouped_ranks, nearest_rank
from parcelflow.plans import complexes, hubs, market, sellers, state, yields


def base(spark, ppms, **extra):
    return listings(spark, [{"ppm": p, "building_key": "b", **extra} for p in ppms])


def estimate(spark, rows, **subject):
    s = listings(spark, [{"id": "s", "building_key": "b", "area_m2": 120.0, **subject}]).drop("discount_percent")
    return market.estimate_from_index(s, market.market_index(rows)).select(
        "market_basis", "market_sample_size", "market_price_per_m2_usd", "discount_percent", "savings_usd", "is_below_market").first()


def test_building_median_and_discount(spark):
    got = estimate(spark, base(spark, [1200, 1200, 1222, 1200, 500]), ppm=900)
    assert tuple(got) == ("building", 5, 1200.0, 25.0, 36000.0, True)


def test_unrealistic_discount_is_hidden(spark):
    got = estimate(spark, base(spark, [1200] * 5), ppm=700)
    assert (got.market_price_per_m2_usd, got.discount_percent, got.is_below_market) == (1200.0, None, False)


def test_outliers_and_extreme_floors_stay_out(spark):
    rows = base(spark, [1200] * 5).unionByName(base(spark, [3200])).unionByName(base(spark, [700] * 3, floor=1)).unionByName(
        base(spark, [700] * 3, floor=9))
    got = estimate(spark, rows, ppm=1100, floor=1)
    assert (got.market_price_per_m2_usd, got.discount_percent) == (1200.0, None)


def test_segments_have_their_own_median(spark):
    rows = base(spark, [1800] * 5, segment="new").unionByName(base(spark, [900] * 5))
    got = table(market.market_index(rows).where("level = 'building'"), "segment", "median", "n")
    assert got == [("new", 1800.0, 5), ("secondary", 900.0, 5)]


def test_district_fallback_and_nothing(spark):
    rows = listings(spark, [{"ppm": p, "building_key": "other"} for p in (1000, 1010, 1020)])
    assert estimate(spark, rows, ppm=1000).market_basis == "district_rooms"
    assert estimate(spark, rows, ppm=1000, district="E").market_basis == "insufficient_data"


def test_median_matches_builtin(spark):
    df = spark.range(20000).select((F.col("id") % 7).alias("k"), F.hash("id").cast("double").alias("v")).unionByName(
        spark.range(5000).select(F.lit(0).cast("long").alias("k"), F.lit(1.5).alias("v"))).unionByName(
        spark.createDataFrame([(None, -0.5), (None, 0.0), (99, None)], "k long, v double"))
    want = df.where("v is not null").groupBy("k").agg(F.median("v").alias("median"), F.count("v").alias("n"))
    assert table(grouped_median(df, ["k"], "v"), "k", "n", "median") == table(want, "k", "n", "median")


def test_several_medians_and_ranks(spark):
    df = spark.createDataFrame([("a", float(i), float(-i)) for i in range(1, 11)], "k string, x double, y double")
    assert table(grouped_medians(df, ["k"], ["x", "y"]), "k", "n", "median_x", "median_y") == [("a", 10, 5.5, -5.5)]
    got = grouped_ranks(df, [], "x", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)}).first()
    assert (got.p50, got.p95, got.n) == (5.0, 10.0, 10)


def test_complex_stats_and_comparison(spark):
    rows = listings(spark, [{"ppm": p, "area_m2": 50.0, "complex": "X"} for p in (1000, 1100, 1200, 1300, 1400)]
                    + [{"ppm": 1000.0, "complex": "thin"}] * 2)
    got = complexes.complex_stats(rows)
    assert table(got, "complex", "count", "median_price_per_m2_usd", "median_price_usd", "min_price_usd") == [
        ("X", 5, 1200.0, 60000.0, 50000.0)]
    cmp = complexes.compare_with_complex(rows, rows).where("complex = 'X' and price_per_m2_usd = 1000").first()
    assert (cmp.vs_complex_percent, cmp.is_below_complex) == (16.7, True)


def test_rental_yield_cascade(spark):
    rents = [{"ppm": p, "area_m2": 50.0, "deal_type": "rent", "price_period": "month", "complex": "X"} for p in (9, 10, 11, 12, 13)]
    med = yields.rent_medians(listings(spark, rents))
    sale = listings(spark, [
        {"id": "a", "ppm": 1000.0, "complex": "X"}, {"id": "b", "ppm": 1200.0, "complex": "Y"},
        {"id": "c", "ppm": 60.0, "complex": "X"}, {"id": "d", "ppm": 1000.0, "district": "E"}])
    got = table(yields.with_yield(sale, med), "id", "gross_yield_percent", "payback_years", "yield_basis", "yield_sample_size")
    assert got == [("a", 13.2, 7.6, "complex", 5), ("b", 11.0, 9.1, "district", 5), ("c", None, None, None, None),
                   ("d", None, None, None, None)]


def test_sellers(spark):
    rows = listings(spark, [{"price_usd": 6e4, "seller_id": s, "is_business": b} for s, b in
                            [("a", False)] * 3 + [("o", False)] + [("u", False)] * 2 + [("biz", True)]])
    got = sellers.classify_sellers(rows)
    assert table(got, "seller_id", "seller_type") == [("a", "agent"), ("biz", "agent"), ("o", "owner"), ("u", "unknown")]
    assert sellers.label_listings(rows, got).where("seller_type is null").count() == 0


def test_hubs(spark):
    rows = listings(spark, [{"price_usd": p, "area_m2": 50.0, "deal_type": "rent"} for p in (300.0, 400.0, 600.0)]
                    + [{"price_usd": 60000.0}] * 2)
    got = hubs.hub_slices(rows).where("level = 'district_rooms'").first()
    assert (got.deal_type, got.total, got.min_price_usd, round(got.avg_price_usd, 1)) == ("rent", 3, 300.0, 433.3)
    slugs = spark.createDataFrame([(7, "Nest One!")], "id long, name string").select(
        hubs.complex_slug(F.col("id"), F.col("name")).alias("s"), hubs.locative(F.lit("Чиланзарский район")).alias("l")).first()
    assert tuple(slugs) == ("7-nest-one", "Чиланзарском районе")
    made = spark.createDataFrame([("Центр Плаза",), ("Чиланзарский район",), ("Қўқон",)], "x string").select(
        hubs.complex_slug(F.lit(1), F.col("x")).alias("c"), hubs.district_slug(F.col("x")).alias("d"))
    assert [tuple(r) for r in made.collect()] == [("1-centr-plaza", "centr-plaza"), ("1-chilanzarskiy-rayon", "chilanzar"), ("1-on", "on")]


def test_cards_and_public_rows(spark):
    rows = listings(spark, [
        {"price_usd": 5e4, "source": "flat_board", "photos": ["a", "b"], "discount_percent": 20.0},
        {"price_usd": 5e4, "source": "big", "photos": [], "discount_percent": 5.0},
        {"price_usd": 5e4, "source": "b2b", "photos": None},
    ]).withColumns({"is_below_market": F.col("discount_percent") >= 15, "market_price_per_m2_usd": F.lit(None).cast("double"),
                    "market_sample_size": F.lit(None).cast("int"), "market_basis": F.expr("IF(id < '3', 'building', NULL)"),
                    "market_confidence": F.lit(None).cast("string")})
    got = table(hubs.card_rows(rows, {"big": "The Big One"}), "id", "photo", "discount_percent", "source_label")
    assert got == [("1", "a", 20.0, "Flat_Board"), ("2", None, None, "The Big One"), ("3", None, None, "B2B")]
    got = table(hubs.public_rows(rows), "id", "market.basis", "market.sample_size", "market.confidence", "market.is_below_market")
    assert got == [("1", "building", 0, "low", True), ("2", "building", 0, "low", False), ("3", None, None, None, None)]
    assert table(state.pending_estimate(rows), "id") == [("3",)]
