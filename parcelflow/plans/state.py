"""Listing snapshot merge: known key, same flat, or new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow import constants as K
from parcelflow.operators.keys import join_on
from parcelflow.operators.pivot_clusters import pivot_clusters
from parcelflow.operators.predicates import plausible, price_drop
from parcelflow.plans import resolve
from parcelflow.plans.history import gap_days
from parcelflow.sources.storage import materialise

KEY = ["source", "source_id"]
# A detail-confirmed USD price of this page-scraped source outlives the search page's UZS figure.
DETAIL_PRICED_SOURCES = ("offer_page",)
KEEP_WHEN_UNKNOWN = ["seller_type", "is_business", "is_furnished", "commission_pct"]
PRICE_COLUMNS = ["price", "currency", "price_usd", "price_per_m2_usd"]


def coords_rank(precision: Column) -> Column:
    return F.when(precision == "exact", 2).when(precision == "approx", 1).otherwise(0)


def known(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows already stored."""
    return join_on(incoming, stored.select(*KEY), KEY, "left_semi")


def unknown(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return join_on(incoming, stored.select(*KEY), KEY, "left_anti")


def needs_probe(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """UZS rows whose converted price left the FX-noise window around a stored USD price."""
    held = stored.select(*KEY, F.col("currency").alias("held_currency"), F.col("price_usd").alias("held_price"))
    ratio = F.try_divide(F.col("price_usd"), F.col("held_price"))
    return join_on(incoming, held, KEY).where(
        (F.upper("currency") == "UZS") & (F.upper("held_currency") == "USD") & (F.col("held_price") > 0)
        & (F.col("price_usd") > 0) & ~ratio.between(*K.FX_NOISE_RATIO)).drop("held_currency")


def upsert(stored: DataFrame, incoming: DataFrame, as_of: str, *, preserve_sources: tuple[str, ...] = DETAIL_PRICED_SOURCES,
           routed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K1/K2 in batch form; returns (new snapshot, events).

    Incoming rows carry ``price_usd``, ``price_per_m2_usd``, ``duplicate_group_key`` and an ``id``;
    stored rows the same columns plus ``status`` and ``seen_at``.  ``routed`` is the result of :func:`route`, if it
    is at hand already.  The batch is settled as a set:

    * the latest row per (source, source_id) counts;
    * a row whose key is stored updates that listing;
    * otherwise it joins the stored listing with its fingerprint, or the same flat within the
      price tolerance, and overwrites the displayed fields only when it asks less;
    * the rest are new; new rows sharing a fingerprint, or the same flat within the price tolerance,
      become one listing, the cheapest.  A missing fingerprint equals no other;
    * a confirmed price of a ``preserve_sources`` listing outlives their search-page figures, whether
      these come under its own key or as a cheaper repost.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    routed = route(stored, incoming) if routed is None else routed
    return _settled_snapshot(stored, routed, now, preserve_sources), _upsert_events(routed, stored, now, preserve_sources)


def route(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The batch's rows with the listing they belong to (``target``) and ``how`` they got there."""
    batch = materialise(
        incoming.withColumn("__rn", F.row_number().over(
            Window.partitionBy(*KEY).orderBy(F.col("published_at").desc_nulls_last(), "price_usd", "id")))
        .where("__rn = 1").drop("__rn"), "upsert-batch")
    own = stored.select(*KEY, F.col("id").alias("target"))
    by_key = join_on(batch, own, KEY).withColumn("how", F.lit("known"))
    rest = materialise(join_on(batch, own, KEY, "left_anti"), "upsert-rest")

    best = stored.where(F.col("duplicate_group_key").isNotNull()).groupBy("deal_type", "duplicate_group_key").agg(
        F.min(resolve.rank_key()).alias("k")).select("deal_type", "duplicate_group_key", F.col("k.id").alias("target"))
    by_print = join_on(rest, best, ["deal_type", "duplicate_group_key"]).withColumn("how", F.lit("duplicate"))
    still = rest.join(by_print.select("id"), "id", "left_anti")
    flat = resolve.same_flat(still, stored).select("id", F.col("duplicate_id").alias("target"))
    by_flat = still.join(flat, "id").withColumn("how", F.lit("duplicate"))
    fresh = materialise(still.join(flat, "id", "left_anti"), "upsert-fresh")
    new = fresh.join(_new_groups(fresh), "id").withColumn(
        "how", F.when(F.col("id") == F.col("target"), "new").otherwise("duplicate"))
    return materialise(by_key.unionByName(by_print).unionByName(by_flat).unionByName(new), "upsert-routed")


def _new_groups(fresh: DataFrame) -> DataFrame:
    """(id, target) of rows that are new together: one fingerprint first, then one flat among the cheapest of these."""
    cheapest = F.min(F.struct(F.coalesce("price_usd", F.lit(float("inf"))).alias("price"), F.col("id"))).alias("k")
    printed = fresh.where(F.col("duplicate_group_key").isNotNull())
    lead = printed.groupBy("deal_type", "duplicate_group_key").agg(cheapest).select(
        "deal_type", "duplicate_group_key", F.col("k.id").alias("lead"))
    by_print = join_on(printed.select("id", "deal_type", "duplicate_group_key"), lead, ["deal_type", "duplicate_group_key"]).select("id", "lead")
    leads = materialise(by_print.unionByName(
        fresh.where(F.col("duplicate_group_key").isNull()).select("id", F.col("id").alias("lead"))), "upsert-leads")
    heads = fresh.join(leads.select(F.col("lead").alias("id")).distinct(), "id", "left_semi").where(
        F.col("rooms").isNotNull() & F.col("area_m2").isNotNull())
    flats = resolve.floor_groups(
        pivot_clusters(heads, resolve.FLAT_KEYS, "price_usd", K.DUPLICATE_PRICE_TOLERANCE), resolve.FLAT_KEYS)
    group = [*resolve.FLAT_KEYS, "pivot", "floor_group"]
    first = flats.groupBy(*group).agg(cheapest).select(*group, F.col("k.id").alias("first"))
    by_flat = join_on(flats.select("id", *group), first, group).select(F.col("id").alias("lead"), "first")
    return leads.join(by_flat, "lead", "left").select("id", F.coalesce("first", "lead").alias("target"))


def source_url_rows(links: DataFrame, routed: DataFrame) -> DataFrame:
    """K1/H4: the listings' (listing_id, source, url) rows with those of a routed batch; each counts once."""
    more = routed.select(F.col("target").alias("listing_id"), "source", "url")
    return links.select("listing_id", "source", "url").unionByName(more).distinct()


def with_duplicate_count(snapshot: DataFrame, links: DataFrame) -> DataFrame:
    """The listings with the number of places they are offered at, one at least."""
    counts = links.groupBy(F.col("listing_id").alias("id")).agg(F.count(F.lit(1)).alias("__n"))
    return snapshot.drop("duplicate_count").join(counts, "id", "left").withColumn(
        "duplicate_count", F.coalesce("__n", F.lit(1)).cast("int")).drop("__n")


def _settled_snapshot(stored: DataFrame, routed: DataFrame, now: Column, preserve_sources: tuple[str, ...]) -> DataFrame:
    batch = routed.drop("target", "how")
    # One row per target: the first row (known or new) sets the base, the cheapest duplicate may beat it.
    row = F.struct(*[c for c in batch.columns])
    duplicate = F.col("how") == "duplicate"
    hits = routed.groupBy("target").agg(
        F.max_by(row, F.when(~duplicate, F.col("id"))).alias("main"),
        F.min_by(row, F.when(duplicate, F.struct("price_usd", "id"))).alias("cheap"),
        F.max(F.col("how") == "new").alias("is_new"),
        F.max_by(F.col("floor"), F.when(F.col("floor").isNotNull(), F.struct(~duplicate, F.col("id")))).alias("any_floor"),
        F.max_by(F.col("total_floors"), F.when(F.col("total_floors").isNotNull(), F.struct(~duplicate, F.col("id")))).alias("any_total"),
        F.max(F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(),
                     F.struct(coords_rank(F.col("coords_precision")).alias("rank"), F.col("id"), F.col("lat"), F.col("lng"),
                              F.col("coords_precision")))).alias("point"),
    )
    old_row = stored.select(F.col("id").alias("target"), F.struct(*stored.columns).alias("old"))
    merged = hits.join(old_row, "target", "full_outer")
    old_price = F.col("old.price_usd")

    def outlived(row: str) -> Column:
        return F.coalesce(
            F.col(f"{row}.source").isin(*preserve_sources) & (F.upper(F.col(f"{row}.currency")) == "UZS")
            & F.col("old.source").isin(*preserve_sources) & (F.upper(F.col("old.currency")) == "USD") & (old_price > 0),
            F.lit(False))

    keeps_price = outlived("main")
    base_price = F.when(F.col("main").isNull() | keeps_price, old_price).otherwise(F.col("main.price_usd"))
    cheaper = F.coalesce(F.col("cheap.price_usd") < base_price, F.col("cheap").isNotNull() & base_price.isNull(), F.lit(False))
    touched = F.col("main").isNotNull() | F.col("cheap").isNotNull()

    out = {}
    for c in stored.columns:
        old = F.col(f"old.{c}")
        if c == "id":
            out[c] = F.col("target")
        elif c == "seen_at":
            out[c] = F.when(touched, now).otherwise(old)
        elif c == "status":
            out[c] = F.when(touched, F.lit("active")).otherwise(old)
        elif c not in batch.columns:
            out[c] = old
        elif c == "duplicate_group_key":
            # set when the listing is created, so that a later repost at the first price still finds it
            out[c] = F.when(F.col("old").isNotNull(), old).otherwise(F.col(f"main.{c}"))
        else:
            main, cheap = F.col(f"main.{c}"), F.col(f"cheap.{c}")
            if c in KEEP_WHEN_UNKNOWN:
                out[c] = F.when(cheaper, F.coalesce(cheap, main, old)).otherwise(F.coalesce(main, old))
            elif c in PRICE_COLUMNS:
                out[c] = F.when(cheaper & ~outlived("cheap"), cheap).when(F.col("main").isNull() | keeps_price, old).otherwise(main)
            elif c in ("floor", "total_floors"):
                spare = F.col("any_floor" if c == "floor" else "any_total")
                out[c] = F.when(cheaper, F.coalesce(cheap, spare)).when(
                    F.col("main").isNotNull(), F.coalesce(main, spare)).otherwise(F.coalesce(old, spare))
            elif c in ("lat", "lng", "coords_precision"):
                old_rank = F.when(F.col("old.lat").isNull(), -1).otherwise(coords_rank(F.col("old.coords_precision")))
                takes = F.coalesce(F.col("point.rank") >= old_rank, F.lit(False)) | (
                    F.col("old").isNull() & F.col("point").isNotNull())
                out[c] = F.when(takes, F.col(f"point.{c}")).otherwise(old)
            else:
                out[c] = F.when(cheaper, cheap).when(F.col("main").isNotNull(), main).otherwise(old)
    return merged.select(*[v.alias(k) for k, v in out.items()])


def _upsert_events(routed: DataFrame, stored: DataFrame, now: Column, preserve: tuple[str, ...]) -> DataFrame:
    held = stored.select(F.col("id").alias("target"), F.col("price_usd").alias("was_price"), F.col("status").alias("was_status"),
                         F.col("seen_at").alias("was_seen"), F.col("source").alias("was_source"),
                         F.col("currency").alias("was_currency"))
    gap = gap_days(F.col("was_seen"), now)
    back = F.coalesce((F.col("was_status") == "removed") | (gap >= K.RELIST_GAP_DAYS), F.lit(False))
    keeps_price = F.coalesce(
        F.col("source").isin(*preserve) & (F.upper("currency") == "UZS") & F.col("was_source").isin(*preserve)
        & (F.upper("was_currency") == "USD") & (F.col("was_price") > 0), F.lit(False))
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def event(kind, old_price, new_price, old_status, new_status):
        return F.struct(F.lit(kind).alias("event_type"), old_price.alias("old_price_usd"), new_price.alias("new_price_usd"),
                        old_status.alias("old_status"), new_status.alias("new_status"))

    active = F.lit("active")
    raised = F.array_compact(F.array(
        F.when(F.col("how") == "new", event("first_seen", none_d, F.col("price_usd"), none_s, active)),
        F.when((F.col("how") != "new") & back, event("relisted", none_d, none_d, F.col("was_status"), active)),
        F.when((F.col("how") != "new") & ~keeps_price & price_drop(F.col("was_price"), F.col("price_usd")),
               event("price_changed", F.col("was_price"), F.col("price_usd"), none_s, none_s)),
    ))
    return routed.join(held, "target", "left").select(
        F.col("target").alias("listing_id"), "source", "source_id", now.alias("at"), F.explode(raised).alias("e")
    ).select("listing_id", "e.*", "source", "source_id", "at")


def apply_probes(listings: DataFrame, probes: DataFrame, as_of: str, *, fix: float = K.PROBE_PRICE_TOLERANCE,
                 drop: float = K.PRICE_DROP_MIN) -> tuple[DataFrame, DataFrame]:
    """Apply detail-page probes; returns (listings, events).

    Probe columns: ``url, is_gone, photos, usd_price, floor, total_floors``.  Gone rows are
    removed with an event; photos and floors only fill gaps; a USD price at least ``fix`` away
    replaces the stored one and raises an event when it fell by more than ``drop``.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    p = probes.select("url", F.struct("is_gone", "photos", "usd_price", "floor", "total_floors").alias("p"))
    j = listings.join(p, "url", "left")
    gone = F.coalesce(F.col("p.is_gone"), F.lit(False)) & (F.col("status") == "active")
    alive = F.col("p").isNotNull() & ~F.coalesce(F.col("p.is_gone"), F.lit(False))
    usd, was = F.col("p.usd_price"), F.col("price_usd")
    fixes = F.coalesce(alive & (usd > 0) & (was.isNull() | (F.abs(was - usd) / was >= fix)), F.lit(False))
    j = j.withColumn("__gone", gone).withColumn("__fix", fixes).withColumn("__was", was)
    marked = j.withColumns({
        "status": F.when(gone, "removed").otherwise(F.col("status")),
        "seen_at": F.when(gone, now).otherwise(F.col("seen_at")),
        "photos": F.when(alive & (F.coalesce(F.size("photos"), F.lit(0)) <= 0) & (F.size("p.photos") > 0), F.col("p.photos")
                         ).otherwise(F.col("photos")),
        "floor": F.when(alive, F.coalesce("floor", "p.floor")).otherwise(F.col("floor")),
        "total_floors": F.when(alive, F.coalesce("total_floors", "p.total_floors")).otherwise(F.col("total_floors")),
        "price": F.when(fixes, usd).otherwise(F.col("price")),
        "currency": F.when(fixes, "USD").otherwise(F.col("currency")),
        "price_usd": F.when(fixes, usd).otherwise(was),
        "price_per_m2_usd": F.when(fixes & (F.col("area_m2") > 0), F.round(usd / F.col("area_m2"), 2)
                                   ).otherwise(F.col("price_per_m2_usd")),
    })
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    raised = F.when(F.col("__gone"), F.struct(
        F.lit("delisted").alias("event_type"), F.col("__was").alias("old_price_usd"), none_d.alias("new_price_usd"),
        F.lit("active").alias("old_status"), F.lit("removed").alias("new_status"))
    ).when(F.col("__fix") & price_drop(F.col("__was"), F.col("p.usd_price"), drop), F.struct(
        F.lit("price_changed").alias("event_type"), F.col("__was").alias("old_price_usd"),
        F.col("p.usd_price").alias("new_price_usd"), none_s.alias("old_status"), none_s.alias("new_status")))
    events = j.select(F.col("id").alias("listing_id"), raised.alias("e"), now.alias("at")).where(
        F.col("e").isNotNull()).select("listing_id", "e.*", "at")
    return marked.drop("p", "__gone", "__fix", "__was"), events


def without_photos(listings: DataFrame, source: str | None = None) -> DataFrame:
    """Active rows that still need photos, most recently seen first."""
    need = (F.col("status") == "active") & (F.coalesce(F.size("photos"), F.lit(0)) <= 0)
    if source is not None:
        need = need & (F.col("source") == source)
    return listings.where(need).orderBy(F.col("seen_at").desc_nulls_last(), "id")


def pending_estimate(listings: DataFrame) -> DataFrame:
    """C11: active rows that were never valued."""
    return listings.where((F.col("status") == "active") & F.col("market_basis").isNull())


def gate(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plausible rows, rejected rows per source and deal type)."""
    ok = F.coalesce(plausible(), F.lit(False))
    rejected = incoming.where(~ok).groupBy("source", "deal_type").agg(F.count(F.lit(1)).alias("rejected"))
    return incoming.where(ok), rejected


def purge(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Drop the listed keys."""
    return join_on(rows, keys.select(*on).distinct(), on, "left_anti")


def ingest_cycle(stored: DataFrame, incoming: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Gate, upsert, delist and classify sellers; one row per source describes the run."""
    from parcelflow.plans.history import delist
    from parcelflow.plans.sellers import classify_sellers, label_listings

    kept, rejected = gate(incoming)
    snapshot, events = upsert(stored, kept, as_of)
    snapshot = materialise(snapshot, "cycle-snapshot")
    marked, gone = delist(snapshot, as_of)
    labelled = label_listings(marked, classify_sellers(marked))
    first = F.count_if(F.col("event_type") == "first_seen")
    runs = kept.groupBy("source").agg(F.count(F.lit(1)).alias("found")).join(
        events.groupBy("source").agg(first.alias("new_count")), "source", "left").join(
        rejected.groupBy("source").agg(F.sum("rejected").alias("rejected")), "source", "left").select(
        "source", "found", F.coalesce("new_count", F.lit(0)).alias("new_count"), F.coalesce("rejected", F.lit(0)).alias("rejected"),
        F.lit("success").alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("finished_at"))
    return {"listings": labelled, "events": events, "delisted": gone, "runs": runs}
