"""Hub slices, their cards, links and the URL catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow import constants as K
from parcelflow.functions.complex_names import slug_text
from parcelflow.functions.vocabulary import DISTRICT_SLUGS
from parcelflow.operators.keys import join_on
from parcelflow.operators.predicates import sane_active
from parcelflow.plans.search import hub_order

SLICE = ["deal_type", "district", "rooms"]

# Path prefixes, change frequencies and priorities of the public catalogue.
PREFIX = {"sale": "/kvartira", "rent": "/arenda"}
STATIC_PAGES = [
    ("/", "daily", "1.0"),
    ("/kvartira", "daily", "0.8"),
    ("/terms", "monthly", "0.3"),
    ("/disclaimer", "monthly", "0.3"),
    ("/removal", "monthly", "0.3"),
]


def hub_slices(listings: DataFrame, districts: list[str] | None = None, *,
               min_listings: int = K.HUB_MIN_LISTINGS) -> DataFrame:
    """Every (deal type[, district][, rooms]) slice with enough listings.

    One expand and one shuffle serve the district, rooms and combined levels; a NULL column
    means the slice is not restricted by it.  Rooms run from 1 to 6, and the unspecified
    district never makes a hub.
    """
    base = listings.where(sane_active()).select("deal_type", "district", "rooms", "price_usd", "price_per_m2_usd")
    # As in SQL, a level that does not use a column keeps rows whatever that column holds.
    named = F.col("district").isin(*districts) if districts else (
        F.col("district").isNotNull() & (F.col("district") != K.UNSPECIFIED_DISTRICT))
    sets = base.groupingSets(
        [["deal_type", "district"], ["deal_type", "rooms"], ["deal_type", "district", "rooms"]],
        "deal_type", "district", "rooms",
    ).agg(
        F.grouping("district").alias("all_districts"), F.grouping("rooms").alias("all_rooms"),
        F.count(F.lit(1)).alias("total"),
        F.min("price_usd").alias("min_price_usd"),
        F.avg("price_per_m2_usd").alias("avg_ppm_usd"),
        F.when(F.col("deal_type") == "rent", F.avg("price_usd")).alias("avg_price_usd"),
    )
    return sets.where(
        (F.col("total") >= min_listings)
        & ((F.col("all_districts") == 1) | named)
        & ((F.col("all_rooms") == 1) | F.col("rooms").between(1, 6))
    ).withColumn("level", F.when(F.col("all_rooms") == 1, "district").when(F.col("all_districts") == 1, "rooms")
                 .otherwise("district_rooms")).drop("all_districts", "all_rooms")


def hub_cards(listings: DataFrame, *, limit: int = K.HUB_LIST_LIMIT) -> DataFrame:
    """G3 for all combined slices at once; the rank filter is pushed below the shuffle."""
    order = Window.partitionBy(*SLICE).orderBy(*hub_order())
    return listings.where(sane_active()).withColumn("card", F.row_number().over(order)).where(F.col("card") <= limit)


def below_market_in_cards(cards: DataFrame) -> DataFrame:
    """Below-market rows among the cards a slice shows."""
    return cards.groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("cards"),
        F.count_if(F.coalesce(F.col("discount_percent") >= K.BELOW_MARKET_PERCENT, F.lit(False))).alias("below_market"))


def rooms_breakdown(listings: DataFrame) -> DataFrame:
    """Count and average price per district and room count, rooms 1 to 5."""
    return listings.where(sane_active() & F.col("rooms").between(1, 5)).groupBy("deal_type", "district", "rooms").agg(
        F.count(F.lit(1)).alias("count"), F.avg("price_usd").alias("avg_price"))


def mirror_slices(slices: DataFrame) -> DataFrame:
    """Each slice that also exists under the other deal type, with that side's count."""
    other = slices.select(
        F.when(F.col("deal_type") == "sale", "rent").otherwise("sale").alias("deal_type"),
        "district", "rooms", "level", F.col("total").alias("mirror_total"))
    return join_on(slices.select("deal_type", "district", "rooms", "level", "total"), other,
                   ["deal_type", "district", "rooms", "level"])


def related_slices(slices: DataFrame) -> DataFrame:
    """Per combined slice, how many sibling slices share its district or its rooms."""
    combos = slices.where(F.col("level") == "district_rooms").select("deal_type", "district", "rooms")
    by_district = combos.groupBy("deal_type", "district").agg((F.count(F.lit(1)) - 1).alias("other_rooms"))
    by_rooms = combos.groupBy("deal_type", "rooms").agg((F.count(F.lit(1)) - 1).alias("other_districts"))
    return join_on(join_on(combos, by_district, ["deal_type", "district"]), by_rooms, ["deal_type", "rooms"])


def related_links(slices: DataFrame) -> DataFrame:
    """For each slice the slices its page links to, as rows; only slices that exist are linked.

    A district page links to its room counts and to the other districts, a rooms page to its districts and the other
    room counts, a combined page to the other room counts of the district and the other districts with its rooms.
    """
    rows = slices.select("deal_type", "level", "district", "rooms")
    to = slices.select("deal_type", F.col("level").alias("to_level"), F.col("district").alias("to_district"), F.col("rooms").alias("to_rooms"))
    d, r, both = (F.lit(x) for x in ("district", "rooms", "district_rooms"))

    def linked(source: Column, target: Column, keys: list[str], differs: list[str]) -> DataFrame:
        a, b = rows.where(F.col("level") == source), to.where(F.col("to_level") == target)
        on = [F.col(k) == F.col(f"to_{k}") for k in keys] + [F.col(k) != F.col(f"to_{k}") for k in differs]
        return a.join(b.withColumnRenamed("deal_type", "__deal"), [F.col("deal_type") == F.col("__deal"), *on]).drop("__deal")

    parts = [linked(d, both, ["district"], []), linked(d, d, [], ["district"]), linked(r, both, ["rooms"], []), linked(r, r, [], ["rooms"]),
             linked(both, both, ["district"], ["rooms"]), linked(both, both, ["rooms"], ["district"])]
    return reduce(DataFrame.unionByName, parts)


def rooms_slug(rooms: Column) -> Column:
    return F.concat(rooms.cast("string"), F.lit("-komnatnye"))


def rooms_from_slug(slug: Column) -> Column:
    return F.try_element_at(F.split(F.regexp_extract(slug, r"^([1-9])-komnatnye$", 1), ""), F.lit(1)).try_cast("int")


def district_slug(district: Column) -> Column:
    """The fixed slug of a known district, else one made from its name."""
    known = F.create_map(*[F.lit(x) for pair in DISTRICT_SLUGS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, district), slug_text(district))


def complex_slug(ident: Column, name: Column) -> Column:
    tail = slug_text(name)
    return F.when(tail == "", ident.cast("string")).otherwise(F.concat_ws("-", ident.cast("string"), tail))


def complex_id_from_slug(slug: Column) -> Column:
    return F.regexp_extract(slug, r"^(\d+)(?:-.*)?$", 1).try_cast("long")


def locative(district: Column) -> Column:
    """The form used after a preposition."""
    return F.replace(district, F.lit("ский район"), F.lit("ском районе"))


def last_modified(listings: DataFrame, column: str = "updated_at") -> DataFrame:
    """Newest change per deal type."""
    return listings.where(sane_active()).groupBy("deal_type").agg(F.max(column).alias("last_at"))


def catalogue(listings: DataFrame, slices: DataFrame, complexes: DataFrame, *, slug: Column | None = None,
              complex_path: Column | None = None, modified: str = "updated_at") -> DataFrame:
    """The URL catalogue as rows ``loc, lastmod, changefreq, priority``.

    ``slug`` maps a slice's district to its path part and ``complex_path`` a complex to its
    path.  The sale side's date stamps the static and complex pages.
    """
    slug = district_slug(F.col("district")) if slug is None else slug
    spark = listings.sparkSession
    stamp = last_modified(listings, modified).select("deal_type", F.date_format("last_at", "yyyy-MM-dd").alias("lastmod"))
    prefix = F.when(F.col("deal_type") == "rent", PREFIX["rent"]).otherwise(PREFIX["sale"])
    static = spark.createDataFrame(
        [("sale", *p) for p in STATIC_PAGES] + [("rent", "/arenda", "daily", "0.8"), ("sale", "/jk", "daily", "0.7")],
        "deal_type string, loc string, changefreq string, priority string")
    hubs = slices.select(
        "deal_type",
        F.concat_ws("/", prefix, slug, F.when(F.col("rooms").isNotNull(), rooms_slug(F.col("rooms")))).alias("loc"),
        F.lit("daily").alias("changefreq"),
        F.when(F.col("level") == "district", "0.7").otherwise("0.6").alias("priority"))
    homes = complexes.select(
        F.lit("sale").alias("deal_type"),
        F.concat(F.lit("/jk/"), slug_text(F.col("complex")) if complex_path is None else complex_path).alias("loc"),
        F.lit("weekly").alias("changefreq"), F.lit("0.6").alias("priority"))
    rows = static.unionByName(hubs).unionByName(homes)
    return rows.join(stamp, "deal_type", "left").select("loc", "lastmod", "changefreq", "priority")


CARD = ["url", "title", "price_usd", "price_per_m2_usd", "rooms", "area_m2", "floor", "total_floors", "district"]
MARKET = ["market_price_per_m2_usd", "market_sample_size", "market_basis", "market_confidence", "discount_percent", "is_below_market"]


def source_label(source: Column, labels: dict[str, str]) -> Column:
    """The label of a known source; another one's name with every run of letters capitalised."""
    runs = F.regexp_extract_all(F.lower(source), F.lit(r"(\p{L}+|\P{L}+)"))
    named = F.array_join(F.transform(runs, F.initcap), "")
    for name, label in labels.items():
        named = F.when(source == name, F.lit(label)).otherwise(named)
    return named


def card_rows(listings: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """What a card shows: the first photo, the source's label, and a discount only below the market."""
    return listings.select(
        "id", *CARD, F.col("address_raw").alias("address"), F.get("photos", F.lit(0)).alias("photo"),
        F.when(F.col("is_below_market"), F.col("discount_percent")).alias("discount_percent"),
        "source", source_label(F.col("source"), labels or {}).alias("source_label"))


def public_rows(listings: DataFrame) -> DataFrame:
    """Listings with their estimate as one struct, NULL while they were never valued."""
    valued = F.col("market_basis").isNotNull() | F.col("market_price_per_m2_usd").isNotNull()
    market = F.struct(
        "market_price_per_m2_usd", F.coalesce("market_sample_size", F.lit(0)).alias("sample_size"),
        F.coalesce("market_basis", F.lit("insufficient_data")).alias("basis"),
        F.coalesce("market_confidence", F.lit("low")).alias("confidence"), "discount_percent",
        F.coalesce("is_below_market", F.lit(False)).alias("is_below_market"))
    return listings.withColumn("market", F.when(valued, market)).drop(*MARKET)
