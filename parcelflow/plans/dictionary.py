"""The residential-complex dictionary: extraction, get-or-create, merge (J4: L2-L4, E25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelflow.functions import complex_names as CN
from parcelflow.sources.storage import materialise


def named_listings(listings: DataFrame) -> DataFrame:
    """Listings whose text names a complex, with the name and its key."""
    text = F.concat_ws(" ", F.coalesce("address_raw", F.lit("")), F.coalesce("description", F.lit("")))
    named = listings.withColumn("complex_name", CN.extract_name(text))
    return named.where(F.col("complex_name").isNotNull()).withColumn("match_key", CN.match_key(F.col("complex_name")))


def resolve_complexes(named: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L4: (dictionary with new keys added, listing links).

    A new complex takes the name and district of its first listing; its id is a hash of the key,
    so reruns and parallel batches give the same id.
    """
    seen = named.where(F.length("match_key") >= 2)
    new = seen.join(dictionary.select("match_key"), "match_key", "left_anti").groupBy("match_key").agg(
        F.min(F.struct(F.col("id").alias("listing"), F.col("complex_name").alias("name"), "district")).alias("f")
    ).select(F.xxhash64("match_key").alias("id"), F.col("f.name").alias("name"), "match_key", F.col("f.district").alias("district"))
    grown = dictionary.select("id", "name", "match_key", "district").unionByName(new)
    links = seen.select(F.col("id").alias("listing_id"), "match_key").join(
        grown.select("match_key", F.col("id").alias("complex_id")), "match_key").select("listing_id", "complex_id")
    return grown, links


def backfill(listings: DataFrame, dictionary: DataFrame, complex_column: str = "residential_complex_id"):
    """L2: name the listings that have no complex yet; returns (dictionary, listings, report)."""
    # names are read out of the texts once; the dictionary, the links and the report all use them
    named = materialise(named_listings(listings.where(F.col(complex_column).isNull())).select(
        "id", "district", "complex_name", "match_key"), "named-listings")
    grown, links = resolve_complexes(named, dictionary)
    updated = listings.join(links.withColumnRenamed("listing_id", "id"), "id", "left").withColumn(
        complex_column, F.coalesce(F.col(complex_column), F.col("complex_id"))).drop("complex_id")
    todo = listings.where(F.col(complex_column).isNull()).select(F.lit(1).alias("scanned"), F.lit(0).alias("updated"))
    done = links.select(F.lit(0).alias("scanned"), F.lit(1).alias("updated"))
    report = todo.unionByName(done).agg(F.sum("scanned").alias("scanned"), F.sum("updated").alias("updated"))
    return grown, updated, report


def merge_plan(dictionary: DataFrame, active_counts: DataFrame) -> DataFrame:
    """Per dictionary row its new key, canonical id and clean name.

    ``active_counts`` is ``(id, active)``.  The canonical row has the most active listings, then
    the lowest id.  Rows whose name is all noise have no canonical id.
    """
    keyed = dictionary.withColumn("new_key", CN.match_key(F.col("name"))).join(active_counts, "id", "left").withColumn(
        "active", F.coalesce("active", F.lit(0)))
    kept = F.length("new_key") >= 2
    canonical = keyed.where(kept).groupBy("new_key").agg(
        F.max(F.struct(F.col("active"), (-F.col("id")).alias("neg"), F.col("name"))).alias("c"), F.count(F.lit(1)).alias("members")
    ).select("new_key", (-F.col("c.neg")).alias("canonical_id"), F.col("c.name").alias("canonical_name"), "members")
    return keyed.join(canonical, "new_key", "left").withColumn(
        "new_name", F.coalesce(F.nullif(CN.clean_name(F.col("canonical_name")), F.lit("")), F.col("canonical_name"))).drop("canonical_name")


def merge_complexes(dictionary: DataFrame, listings: DataFrame, complex_column: str = "residential_complex_id") -> dict[str, DataFrame]:
    """L3: (dictionary, listings, report) after spellings of one complex became one row.

    Listings of merged rows move to the canonical row, those of noise-only rows lose their
    complex.  Running it again changes nothing.
    """
    linked = listings.where(F.col(complex_column).isNotNull())
    counts = linked.groupBy(F.col(complex_column).alias("id")).agg(
        F.count_if(F.col("status") == "active").alias("active"), F.count(F.lit(1)).alias("linked"))
    plan = merge_plan(dictionary, counts.select("id", "active")).join(counts.select("id", "linked"), "id", "left").withColumn(
        "linked", F.coalesce("linked", F.lit(0)))
    is_canonical = F.col("id") == F.col("canonical_id")
    merged = plan.where(is_canonical).select("id", F.col("new_name").alias("name"), F.col("new_key").alias("match_key"), "district")
    moves = plan.select(F.col("id").alias(complex_column), "canonical_id")
    moved = listings.join(moves, complex_column, "left").withColumn(complex_column, F.col("canonical_id")).drop("canonical_id")
    orphan = F.col("canonical_id").isNull()
    rekeyed = is_canonical & ((F.col("match_key") != F.col("new_key")) | (F.col("name") != F.col("new_name")))
    report = plan.agg(
        F.count(F.lit(1)).alias("complexes_before"),
        F.count_if(is_canonical & (F.col("members") > 1)).alias("merge_groups"),
        F.count_if(~orphan & ~is_canonical).alias("rows_deleted"),
        F.coalesce(F.sum(F.when(~orphan & ~is_canonical, F.col("linked"))), F.lit(0)).alias("listings_repointed"),
        F.count_if(rekeyed).alias("rows_rekeyed"),
        F.count_if(orphan).alias("orphans_dropped"),
        F.coalesce(F.sum(F.when(orphan, F.col("linked"))), F.lit(0)).alias("orphan_listings_nulled"),
        F.count_if(is_canonical).alias("complexes_after"),
    )
    return {"dictionary": merged, "listings": moved, "report": report}
