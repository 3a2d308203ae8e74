"""Seller classes by number of active listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelflow import constants as K
from parcelflow.operators.keys import join_on


def classify_sellers(listings: DataFrame, *, agent_min: int = K.AGENT_MIN_LISTINGS) -> DataFrame:
    """One row per (source, seller); sale and rent rows count together."""
    return (
        listings.where((F.col("status") == "active") & F.col("seller_id").isNotNull())
        .groupBy("source", "seller_id")
        .agg(F.count(F.lit(1)).alias("active_listings"),
             F.max(F.coalesce("is_business", F.lit(False))).alias("business"))
        .withColumn("seller_type", F.when(F.col("business") | (F.col("active_listings") >= agent_min), "agent")
                    .when(F.col("active_listings") == 1, "owner").otherwise("unknown"))
    )


def label_listings(listings: DataFrame, sellers: DataFrame) -> DataFrame:
    """Write the class onto every listing of the seller, removed ones too."""
    fresh = sellers.select("source", "seller_id", F.col("seller_type").alias("__class"))
    out = join_on(listings, fresh, ["source", "seller_id"], "left")
    old = F.col("seller_type") if "seller_type" in listings.columns else F.lit(None)
    return out.withColumn("seller_type", F.coalesce("__class", old)).drop("__class")


def seller_counts(sellers: DataFrame) -> DataFrame:
    return sellers.groupBy("seller_type").agg(F.count(F.lit(1)).alias("sellers"))
