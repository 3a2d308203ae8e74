"""Listing search, its sorts and paging, and the feed statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow import constants as K
from parcelflow.operators.predicates import contains_words, excludes_words, like_escaped, sane_active, seller_filter

TEXT_FIELDS = ["title", "description", "address_raw"]


@dataclass
class Filters:
    """Search request; unset means no restriction, and ``rooms=0`` also means unset."""

    deal_type: str = "sale"
    districts: list[str] = field(default_factory=list)
    rooms: int | None = None
    source: str | None = None
    seller_type: str | None = None
    complex_name: str | None = None
    q: str | None = None
    exclude: str | None = None
    discount_min: float | None = None
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


def search(listings: DataFrame, f: Filters, *, complexes: DataFrame | None = None,
           text_fields: list[str] | None = None) -> DataFrame:
    """Rows that satisfy every filter.  Plain comparisons, so they reach the parquet scan."""
    fields = text_fields or TEXT_FIELDS
    cond = sane_active(f.deal_type)
    if f.districts:
        cond = cond & F.col("district").isin(*f.districts)
    if f.rooms:
        cond = cond & (F.col("rooms") == f.rooms)
    if f.source:
        cond = cond & (F.col("source") == f.source)
    if f.seller_type:
        cond = cond & seller_filter(f.seller_type)
    if f.discount_min is not None:
        cond = cond & (F.col("discount_percent") >= f.discount_min)
    for column, (low, high) in f.bounds.items():
        if low is not None:
            cond = cond & (F.col(column) >= low)
        if high is not None:
            cond = cond & (F.col(column) <= high)
    if f.q:
        cond = cond & contains_words(f.q, fields)
    if f.exclude:
        cond = cond & excludes_words(f.exclude, fields)
    out = listings.where(cond)
    if f.complex_name and f.complex_name.strip() and complexes is not None:
        named = complexes.where(F.col("name").ilike(like_escaped(f.complex_name.strip())))
        out = out.join(named.select(F.col("id").alias("residential_complex_id")), "residential_complex_id", "left_semi")
    return out


def order_for(sort: str = "discount", ident: str = "id") -> list[Column]:
    """G1: total orders; rows without the sorted figure come last."""
    if sort == "price_per_m2":
        return [F.col("price_per_m2_usd").asc_nulls_last(), F.col(ident).asc()]
    if sort == "price":
        return [F.col("price_usd").asc_nulls_last(), F.col(ident).asc()]
    if sort == "fresh":
        return [F.col("seen_at").desc_nulls_last(), F.col(ident).desc()]
    return [F.col("discount_percent").desc_nulls_last(), F.col(ident).asc()]


def hub_order(ident: str = "id") -> list[Column]:
    """Best discount first, then cheaper per m2, then id."""
    return [F.col("discount_percent").desc_nulls_last(), F.col("price_per_m2_usd").asc(), F.col(ident).asc()]


def page(rows: DataFrame, order: list[Column], *, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of 1 to 200 rows; Spark keeps only ``offset + limit`` rows per task."""
    if not 1 <= limit <= K.MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {K.MAX_PAGE} and offset not negative, not {limit} and {offset}")
    return rows.orderBy(*order).offset(offset).limit(limit)


def total(rows: DataFrame) -> DataFrame:
    """The number of rows all pages of a search hold together."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def page_after(rows: DataFrame, after, *, limit: int, ident: str = "id") -> DataFrame:
    """Keyset page, stable under inserts and independent of the page number."""
    return rows.where(F.col(ident) > after).orderBy(ident).limit(limit)


def best_deals(rows: DataFrame, limit: int = 6) -> DataFrame:
    """top discounts."""
    return rows.where(F.col("discount_percent").isNotNull()).orderBy(*order_for("discount")).limit(limit)


def is_hot(threshold: float = K.BELOW_MARKET_PERCENT) -> Column:
    """An unknown discount is not hot."""
    return F.coalesce(F.col("discount_percent") >= threshold, F.lit(False))


def feed_totals(listings: DataFrame, as_of: str, *, deal_type: str = "sale",
                threshold: float = K.BELOW_MARKET_PERCENT) -> DataFrame:
    """Total, hot, hot today, hot yesterday and the number of districts, in one pass."""
    today = F.lit(as_of).cast("timestamp_ntz")
    hot = is_hot(threshold)
    fresh = F.col("created_at")
    return listings.where(sane_active(deal_type)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hot).alias("hot"),
        F.count_if(hot & (fresh >= today)).alias("new_today"),
        F.count_if(hot & (fresh < today) & (fresh >= today - F.expr("INTERVAL 1 DAY"))).alias("new_yesterday"),
        F.countDistinct(F.when(F.col("district") != "", F.col("district"))).alias("districts"),
    )


def feed_districts(listings: DataFrame, *, deal_type: str = "sale") -> DataFrame:
    """The sorted districts of the feed."""
    return listings.where(sane_active(deal_type) & (F.col("district") != "")).select("district").distinct().orderBy("district")


def feed_by_source(listings: DataFrame, *, deal_type: str = "sale",
                   threshold: float = K.BELOW_MARKET_PERCENT) -> DataFrame:
    """Rows and hot rows per source."""
    return listings.where(sane_active(deal_type)).groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_hot(threshold)).alias("hot"))


def district_options(listings: DataFrame) -> DataFrame:
    """H5: sorted distinct districts without the unspecified one."""
    return (
        listings.where((F.col("district") != "") & (F.col("district") != K.UNSPECIFIED_DISTRICT))
        .select("district").distinct().orderBy("district")
    )


def details(listings: DataFrame, keys: DataFrame, ident: str = "id") -> DataFrame:
    """Full rows of the given primary keys."""
    return listings.join(keys.select(ident), ident, "left_semi")


_ANALOG_COLUMNS = {"price": "analog_price_usd", "area": "analog_area_m2", "ppm": "analog_ppm", "rank": "rank", "diff": "diff_percent",
                   "basis": "basis", "id": "analog_id"}


def analog_order(key: str, descending: bool = False) -> list[Column]:
    """The analog table by any of its columns, either way; id breaks ties."""
    c = F.col(_ANALOG_COLUMNS[key])
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("analog_id").asc()]


def analog_places(table: str, key: str, descending: bool = False) -> Column:
    """The ranks of one subject's analogs, an array of structs, in the order of :func:`analog_order`.

    All rows of such a table have one basis, so sorting by it leaves the ids.
    """
    def at(row: Column) -> Column:
        c = row[_ANALOG_COLUMNS[key]]
        if key in ("basis", "id"):
            place = []
        elif descending:
            place = [c.isNull(), ~F.isnan(c), -c]
        else:
            place = [c.isNull(), c]
        return F.struct(*[x.alias(f"k{i}") for i, x in enumerate([*place, row["analog_id"], row["rank"]])], row["rank"].alias("rank"))

    places = F.transform(F.array_sort(F.transform(table, at)), lambda row: row["rank"])
    return F.reverse(places) if key == "id" and descending else places


def any_rows(rows: DataFrame) -> bool:
    """Existence test; reads until the first row."""
    return not rows.isEmpty()
