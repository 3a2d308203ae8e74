"""Typed raw listings to silver listings and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow import constants as K
from parcelflow.functions import features as FE, text as T
from parcelflow.functions import vocabulary as V
from parcelflow.operators.keys import join_on
from parcelflow.operators.predicates import extreme_floor, plausible
from parcelflow.plans.resolve import fingerprint


def normalise_listings(raw: DataFrame, fx: DataFrame | None = None, *, rate: float = K.UZS_PER_USD) -> tuple[DataFrame, DataFrame]:
    """Returns (silver, quarantine with a reason).

    ``fx`` (``currency, per_usd``) overrides the fixed rate for the currencies it lists.
    """
    rows = raw
    if fx is not None:
        rows = rows.join(fx.select(F.upper("currency").alias("__c"), "per_usd"), F.upper("currency") == F.col("__c"), "left").drop("__c")
        usd = F.when(F.col("per_usd").isNotNull(), F.round(F.col("price") / F.col("per_usd"), 2)).otherwise(
            T.to_usd(F.col("price"), F.col("currency"), rate))
    else:
        usd = T.to_usd(F.col("price"), F.col("currency"), rate)
    rows = rows.withColumn("price_usd", usd).drop("per_usd").withColumns({
        "district": T.district(F.col("district")),
        "address_raw": T.collapse(F.col("address_raw")),
        "price_per_m2_usd": T.price_per_m2(F.col("price_usd"), F.col("area_m2")),
        "deal_type": F.coalesce("deal_type", F.lit("sale")),
    })
    reason = F.when(F.coalesce(F.col("area_m2"), F.lit(0.0)) <= 0, "area").when(F.col("price_usd").isNull(), "price").when(
        ~F.coalesce(plausible(), F.lit(False)), "implausible")
    judged = rows.withColumn("reason", reason)
    silver = judged.where(F.col("reason").isNull()).drop("reason").withColumns({
        "building_key": T.building_key(F.col("district"), F.col("address_raw")),
        "duplicate_group_key": fingerprint(F.col("district"), F.lower("address_raw"), F.col("rooms"), F.col("area_m2"), F.col("price_usd")),
    })
    return silver, judged.where(F.col("reason").isNotNull())


def recanonicalise(listings: DataFrame) -> DataFrame:
    """District names through the alias table again; each distinct name is looked up once."""
    names = listings.select("district").distinct().withColumn("__canonical", T.district(F.col("district")))
    return join_on(listings, names, ["district"], "left").withColumn("district", F.col("__canonical")).drop("__canonical")


def district_coverage(silver: DataFrame) -> DataFrame:
    """Share of rows per source whose district no alias matched."""
    return silver.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("district") == K.UNSPECIFIED_DISTRICT).alias("unmatched"))


def feature_columns(title: Column, address: Column, description: Column) -> dict[str, Column]:
    everything, wording = FE.blob(title, address, description), FE.blob(title, description)
    return {
        "segment": FE.segment(everything),
        "material": FE.material(wording),
        "year_built": FE.year_after(wording, V.FEATURE_YEAR_HINTS),
        "micro_location": FE.micro_location(FE.blob(address, title, description)),
    }


def listing_features(silver: DataFrame) -> DataFrame:
    """Text features of every listing, computed once per row."""
    return silver.withColumns(feature_columns(F.col("title"), F.col("address_raw"), F.col("description"))).withColumn(
        "extreme_floor", extreme_floor())


def feature_report(featured: DataFrame) -> DataFrame:
    """Rows and known features per segment."""
    return featured.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"with_{c}") for c in ("material", "year_built", "micro_location")])
