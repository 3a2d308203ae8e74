"""Residential-complex statistics and the comparison hung on each listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelflow import constants as K
from parcelflow.operators.keys import join_on
from parcelflow.operators.predicates import sane_active
from parcelflow.operators.quantiles import grouped_median, grouped_medians


def complex_stats(listings: DataFrame, *, key: str = "complex", deal_type: str | None = "sale",
                  min_listings: int = K.COMPLEX_MIN_LISTINGS) -> DataFrame:
    """Count, median price, median price per m2 and lowest price of every large enough complex."""
    base = listings.where(sane_active(deal_type) & F.col(key).isNotNull())
    med = grouped_medians(base, [key], ["price_usd", "price_per_m2_usd"], min_count=min_listings, count_name="count")
    low = base.groupBy(key).agg(F.min("price_usd").alias("min_price_usd"))
    return join_on(med, low, [key]).select(
        key, "count",
        F.round("median_price_usd", 2).alias("median_price_usd"),
        F.round("median_price_per_m2_usd", 2).alias("median_price_per_m2_usd"),
        F.round("min_price_usd", 2).alias("min_price_usd"),
    )


def complex_order(sort: str = "count", key: str = "complex") -> list:
    """By size (largest first), median price per m2 or median price; name breaks ties."""
    first = {"median_ppm": F.col("median_price_per_m2_usd").asc(), "median_price": F.col("median_price_usd").asc()}
    return [first.get(sort, F.col("count").desc()), F.col(key).asc()]


def compare_with_complex(rows: DataFrame, listings: DataFrame, *, key: str = "complex", deal_type: str = "sale",
                         min_listings: int = K.COMPLEX_MIN_LISTINGS,
                         threshold: float = K.BELOW_MARKET_PERCENT) -> DataFrame:
    """Attach the complex's median and how far below it the listing asks."""
    base = listings.where(sane_active(deal_type) & F.col(key).isNotNull())
    med = grouped_median(base, [key], "price_per_m2_usd", name="complex_median_ppm",
                         count_name="complex_count", min_count=min_listings)
    out = rows.join(med.withColumn("complex_median_ppm", F.round("complex_median_ppm", 2)), key, "left")
    vs = F.round((1 - F.try_divide(F.col("price_per_m2_usd"), F.col("complex_median_ppm"))) * 100, 1)
    return out.withColumn("vs_complex_percent", F.when(F.col("complex_median_ppm") > 0, vs)).withColumn(
        "is_below_complex", F.coalesce(F.col("vs_complex_percent") >= threshold, F.lit(False)))


def complex_rooms(listings: DataFrame, *, key: str = "complex", deal_type: str = "sale") -> DataFrame:
    """Median price per room count (1 to 5) inside each complex."""
    base = listings.where(sane_active(deal_type) & F.col(key).isNotNull() & F.col("rooms").between(1, 5))
    return grouped_median(base, [key, "rooms"], "price_usd", name="median_price", count_name="count").withColumn(
        "median_price", F.round("median_price", 2))


def with_complex_name(listings: DataFrame, complexes: DataFrame, *, link: str = "residential_complex_id") -> DataFrame:
    """Each listing with its complex's name, NULL without a link or when the link points nowhere."""
    names = complexes.select(F.col("id").alias(link), F.col("name").alias("complex_name"))
    return listings.join(names, link, "left")
