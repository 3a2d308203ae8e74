"""Rental yield of sale listings from rent medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelflow import constants as K
from parcelflow.operators.keys import join_on
from parcelflow.operators.predicates import sane_active
from parcelflow.operators.quantiles import grouped_median


def rent_medians(listings: DataFrame, *, complex_key: str = "complex",
                 min_samples: int = K.YIELD_MIN_SAMPLES) -> DataFrame:
    """Median monthly rent per m2 by (complex, rooms) and by (district, rooms) in one pass.

    The rent period does not split the groups here, unlike in the comparables.
    """
    rents = listings.where(sane_active("rent") & F.col("rooms").isNotNull())
    levels = rents.select(
        "rooms", "price_per_m2_usd",
        F.explode(F.array(
            F.struct(F.lit("complex").alias("level"), F.col(complex_key).cast("string").alias("place")),
            F.struct(F.lit("district").alias("level"), F.col("district").alias("place")),
        )).alias("at"),
    ).select("at.level", "at.place", "rooms", "price_per_m2_usd").where(F.col("place") != "")
    return grouped_median(levels, ["level", "place", "rooms"], "price_per_m2_usd", min_count=min_samples
                          ).withColumn("median", F.round("median", 3))


def with_yield(sales: DataFrame, medians: DataFrame, *, complex_key: str = "complex") -> DataFrame:
    """D3: the first tier that has a median decides, even when its yield is then refused."""

    def level(name: str) -> DataFrame:
        return medians.where(F.col("level") == name).select(
            F.col("place").alias(f"__{name}"), "rooms", F.col("median").alias(f"{name}_rent"),
            F.col("n").alias(f"{name}_rent_n"))

    out = sales.withColumn("__complex", F.col(complex_key).cast("string")).withColumn("__district", F.col("district"))
    out = join_on(out, level("complex"), ["__complex", "rooms"], "left")
    out = join_on(out, level("district"), ["__district", "rooms"], "left")
    rent = F.coalesce("complex_rent", "district_rent")
    gross = F.when((F.col("price_per_m2_usd") > 0) & (rent > 0), rent * 12 / F.col("price_per_m2_usd") * 100)
    kept = gross.between(*K.YIELD_RANGE_PERCENT)
    basis = F.when(F.col("complex_rent").isNotNull(), "complex").otherwise("district")
    return out.withColumns({
        "gross_yield_percent": F.when(kept, F.round(gross, 1)),
        "payback_years": F.when(kept, F.round(100 / gross, 1)),
        "rent_median_ppm_month": F.when(kept, rent),
        "yield_basis": F.when(kept, basis),
        "yield_sample_size": F.when(kept, F.coalesce("complex_rent_n", "district_rent_n")),
    }).drop("__complex", "__district", "complex_rent", "complex_rent_n", "district_rent", "district_rent_n")
