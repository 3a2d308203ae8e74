"""Duplicate listings: lookups and the two-pass merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow import constants as K
from parcelflow.operators.keys import digest, group_key, join_on
from parcelflow.operators.nearest import Tolerant, nearest_lists, others
from parcelflow.operators.pivot_clusters import pivot_clusters
from parcelflow.sources.storage import materialise

EXACT_KEYS = ["deal_type", "source", "district", "rooms", "area_m2", "price", "currency"]
FLAT_KEYS = ["deal_type", "source", "district", "rooms", "area_m2"]


def fingerprint(district: Column, address: Column, rooms: Column, area: Column, price: Column) -> Column:
    """SHA-1 over the flat's coarse description; buckets round half to even."""
    area_bucket = (F.bround(area / 2) * 2).cast("long")
    price_bucket = (F.bround(price / 2500) * 2500).cast("long")
    # an unknown part keeps its place, so it cannot shift into its neighbour's
    parts = (district, address, rooms.cast("string"), area_bucket.cast("string"), price_bucket.cast("string"))
    return F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("\u0000")) for p in parts]))


def rank_key(ident: str = "id") -> Column:
    """F1 as one comparable struct: active first, cheapest, most recently seen, lowest id."""
    return F.struct(
        F.when(F.col("status") == "active", 0).otherwise(1).alias("gone"),
        F.coalesce(F.col("price_usd"), F.lit(float("inf"))).alias("price"),
        F.coalesce(-F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(0)).alias("age"),
        F.col(ident).alias("id"),
    )


def first_duplicate(listings: DataFrame, *, keys: list[str]) -> DataFrame:
    """For each listing the best other listing with the same fingerprint, if any.

    Two rows per key are enough: the best one serves everybody else, the second serves the best.
    """
    # written once under a short key, since it is read to rank and to join back
    narrow = materialise(listings.select(digest(group_key(*keys)).alias("flat"), rank_key().alias("k")), "fingerprints")
    ranked = narrow.withColumn("r", F.row_number().over(Window.partitionBy("flat").orderBy("k"))).where(F.col("r") <= 2)
    best = ranked.groupBy("flat").agg(
        F.max(F.when(F.col("r") == 1, F.col("k.id"))).alias("first_id"),
        F.max(F.when(F.col("r") == 2, F.col("k.id"))).alias("second_id"),
    ).where(F.col("second_id").isNotNull())
    return narrow.select("flat", "k.id").join(best, "flat").select(
        "id", F.when(F.col("id") == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id")).alias("duplicate_id"))


def same_flat(incoming: DataFrame, stored: DataFrame, *, tolerance: float = K.DUPLICATE_PRICE_TOLERANCE,
              keys: list[str] = FLAT_KEYS) -> DataFrame:
    """The stored listing of the same flat with the nearest price, lowest id on ties.

    A known incoming floor accepts the same or an unknown stored floor; an unknown one accepts
    any.  This is a nearest-neighbour search with one neighbour, so no pairs are spelled out.
    """
    attrs = [Tolerant("floor", 0, routed=True)]

    def narrow(rows: DataFrame) -> DataFrame:
        return materialise(rows.select("id", "floor", "price_usd", digest(group_key(*keys)).alias("flat")), "flats")

    # written once, since the search reads them on both sides
    same = incoming is stored
    incoming = narrow(incoming)
    stored = incoming if same else narrow(stored)
    lists = nearest_lists(incoming, stored, key="flat", position="price_usd", ident="id", payload=[],
                          k=1, reach=(tolerance, tolerance), attrs=attrs, carry=["id"])
    return (
        lists.select("id", others("near", "id", F.col("id"), 1).alias("hit"))
        .where(F.size("hit") > 0)
        .select("id", F.col("hit")[0]["id"].alias("duplicate_id"), F.col("hit")[0]["price_usd"].alias("duplicate_price_usd"))
    )


def merge_groups(rows: DataFrame, keys: list[str], *, store: bool = False) -> tuple[DataFrame, DataFrame]:
    """Collapse each group to its best row and fill that row's gaps (F1, F2).

    Returns ``(canonical, links)``: ``canonical`` has one row per group of two or more with the
    filled columns and ``members``; ``links`` maps every member to its canonical id.  Only
    min/max aggregates are used, so a group of any size combines map-side.  ``store`` writes
    ``canonical``, for a caller that uses both results.
    """
    k = rank_key()
    fills = {
        c: F.min_by(c, F.when(F.col(c).isNotNull(), k))
        for c in ("floor", "total_floors") if c in rows.columns
    }
    if "photos" in rows.columns:
        fills["photos"] = F.min_by("photos", F.when(F.size("photos") > 0, k))
    groups = rows.groupBy(*keys).agg(
        F.min(k).alias("__best"), F.count(F.lit(1)).alias("members"),
        *[c.alias(f"filled_{n}") for n, c in fills.items()],
    ).where(F.col("members") >= 2)
    canonical = groups.select(
        *keys, F.col("__best.id").alias("canonical_id"), "members", *[f"filled_{n}" for n in fills])
    canonical = materialise(canonical, "merged") if store else canonical
    links = join_on(rows.select(*keys, "id"), canonical.select(*keys, "canonical_id"), keys).select("id", "canonical_id")
    return canonical, links


def floor_groups(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """add ``floor_group``; clusters with two or more known floors split by floor."""
    spread = clustered.groupBy(*keys, "pivot").agg(
        (F.min("floor") < F.max("floor")).alias("__many"))
    out = join_on(clustered, spread, [*keys, "pivot"])
    split = F.coalesce(F.col("__many"), F.lit(False))
    return out.withColumn("floor_group", F.when(split, F.coalesce(F.col("floor").cast("string"), F.lit("unknown")))
                          .otherwise("all")).drop("__many")


def merge_duplicates(listings: DataFrame, *, exact_keys: list[str] = EXACT_KEYS, flat_keys: list[str] = FLAT_KEYS,
                     tolerance: float = K.DUPLICATE_PRICE_TOLERANCE) -> dict[str, DataFrame]:
    """L1: exact copies first, then reposts of the same flat among the survivors.

    Returns ``links`` (dropped id, surviving id, pass), ``survivors`` (listings with gaps filled
    from the rows merged into them) and ``report`` (groups merged and rows dropped per pass).
    Nothing is written here; a dry run simply ignores the survivors.
    """
    listings = materialise(listings, "dedup-input")
    ranked = ["id", "status", "price_usd", "seen_at", *[c for c in ("floor", "total_floors", "photos") if c in listings.columns]]
    copies = listings.select(digest(group_key(*exact_keys)).alias("__copy"), *ranked)
    first, first_links = merge_groups(copies, ["__copy"], store=True)
    first_links = materialise(first_links, "exact-links")
    kept = _fill(listings.join(first_links.where("id <> canonical_id"), "id", "left_anti"), first)
    kept = materialise(kept, "exact-kept")
    flats = kept.where(F.col("rooms").isNotNull() & F.col("area_m2").isNotNull()).select(
        digest(group_key(*flat_keys)).alias("__flat"), *ranked)
    clustered = pivot_clusters(flats, ["__flat"], "price_usd", tolerance, store=True)
    clustered = materialise(floor_groups(clustered, ["__flat"]), "floor-groups")
    group = ["__flat", "pivot", "floor_group"]
    second, second_links = merge_groups(clustered, group, store=True)
    second_links = materialise(second_links, "flat-links")
    survivors = _fill(kept.join(second_links.where("id <> canonical_id"), "id", "left_anti"), second)
    dropped = first_links.where("id <> canonical_id").withColumn("pass", F.lit(1)).unionByName(
        second_links.where("id <> canonical_id").withColumn("pass", F.lit(2)))
    # A pass-1 winner may itself fold into another row in pass 2: follow that second link.
    again = second_links.where("id <> canonical_id").select(
        F.col("id").alias("canonical_id"), F.col("canonical_id").alias("__final"))
    links = dropped.join(again, "canonical_id", "left").select(
        "id", F.coalesce("__final", "canonical_id").alias("canonical_id"), "pass")
    report = dropped.groupBy("pass").agg(
        F.countDistinct("canonical_id").alias("merged_groups"), F.count(F.lit(1)).alias("deleted_rows"))
    return {"links": links, "survivors": survivors, "report": report}


def _fill(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    names = [c for c in canonical.columns if c.startswith("filled_")]
    patch = canonical.select(F.col("canonical_id").alias("id"), *names)
    out = rows.join(patch, "id", "left")
    for n in names:
        own = n.removeprefix("filled_")
        known = F.size(own) > 0 if own == "photos" else F.col(own).isNotNull()
        out = out.withColumn(own, F.when(known, F.col(own)).otherwise(F.coalesce(F.col(n), F.col(own))))
    return out.drop(*names)


def source_links(listings: DataFrame, links: DataFrame) -> DataFrame:
    """H4: distinct (source, url) per surviving listing, as rows so no list grows without bound.

    ``best`` orders them: the link's best member by the canonical rule.
    """
    owner = listings.join(links.select("id", "canonical_id"), "id", "left").withColumn(
        "canonical_id", F.coalesce("canonical_id", "id"))
    return owner.groupBy("canonical_id", "source", "url").agg(F.min(rank_key()).alias("best"))


def duplicate_counts(source_link_rows: DataFrame) -> DataFrame:
    return source_link_rows.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("duplicate_count"))
