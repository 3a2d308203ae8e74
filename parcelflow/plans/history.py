"""Listing events from sightings, and the history summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow import constants as K
from parcelflow.operators.predicates import price_drop
from parcelflow.operators.previous import with_previous

EVENT_COLUMNS = ["listing_key", "event_type", "old_price_usd", "new_price_usd", "old_status", "new_status", "gap_days", "at"]


def sightings_with_previous(sightings: DataFrame, *, key: str = "listing_key") -> DataFrame:
    """Each sighting next to the one before it."""
    return with_previous(sightings, [key], ["seen_at", "id"], ["seen_at", "price_usd"])


def gap_days(earlier: Column, later: Column) -> Column:
    """Whole days between two instants."""
    return F.floor(F.timestamp_diff("SECOND", earlier, later) / 86400).cast("int")


def event(kind: str, old_price, new_price, old_status, new_status, days) -> Column:
    return F.struct(F.lit(kind).alias("event_type"), old_price.alias("old_price_usd"), new_price.alias("new_price_usd"),
                    old_status.alias("old_status"), new_status.alias("new_status"), days.alias("gap_days"))


def raised_events(*, relist_days: int = K.RELIST_GAP_DAYS, drop: float = K.PRICE_DROP_MIN, was_removed: Column | None = None) -> Column:
    """the events that a sighting raises against ``prev``; a listing that was removed is back whatever the gap."""
    gap = gap_days(F.col("prev.seen_at"), F.col("seen_at"))
    removed = F.lit(False) if was_removed is None else F.coalesce(was_removed, F.lit(False))
    none_d, none_s, none_i = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("int")
    price, active = F.col("price_usd"), F.lit("active")
    return F.array_compact(F.array(
        F.when(F.col("prev").isNull(), event("first_seen", none_d, price, none_s, active, none_i)),
        F.when((gap >= relist_days) | removed, event("relisted", none_d, none_d, F.when(removed, "removed").otherwise("active"), active, gap)),
        F.when(price_drop(F.col("prev.price_usd"), price, drop),
               event("price_changed", F.col("prev.price_usd"), price, none_s, none_s, none_i)),
    ))


def unseen_event(price: Column) -> Column:
    """K3: the event of a listing that is no longer seen."""
    return event("delisted", price, F.lit(None).cast("double"), F.lit("active"), F.lit("removed"), F.lit(None).cast("int"))


def listing_events(linked: DataFrame, *, relist_days: int = K.RELIST_GAP_DAYS, drop: float = K.PRICE_DROP_MIN) -> DataFrame:
    """first_seen, relisted and price_changed events; one sighting may raise two."""
    raised = raised_events(relist_days=relist_days, drop=drop)
    return linked.select("listing_key", F.col("seen_at").alias("at"), F.explode(raised).alias("e")).select(
        "listing_key", "e.*", "at").select(*EVENT_COLUMNS)


def delist(listings: DataFrame, as_of: str, *, days: int = K.DELIST_AFTER_DAYS,
           scope: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """K3: mark active rows unseen for ``days`` as removed; returns (listings, delisted events).

    ``scope`` limits the job, for example to one source and deal type.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    stale = (F.col("status") == "active") & (F.col("seen_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    for column, wanted in (scope or {}).items():
        stale = stale & (F.col(column) == wanted)
    events = listings.where(stale).select(
        F.col("id").alias("listing_key"), F.lit("delisted").alias("event_type"), F.col("price_usd").alias("old_price_usd"),
        F.lit(None).cast("double").alias("new_price_usd"), F.lit("active").alias("old_status"),
        F.lit("removed").alias("new_status"), F.lit(None).cast("int").alias("gap_days"), now.alias("at"))
    marked = listings.withColumn("status", F.when(F.coalesce(stale, F.lit(False)), "removed").otherwise(F.col("status")))
    return marked, events


def history_summary(events: DataFrame, current: DataFrame) -> DataFrame:
    """First price, total change and event counts of each listing.

    ``current`` has ``listing_key, current_price_usd, created_at``.  Without a first_seen event
    the first price and the change stay unknown.
    """
    kind = F.col("event_type")
    is_first = kind == "first_seen"
    agg = events.groupBy("listing_key").agg(
        F.min(F.when(is_first, F.col("at"))).alias("__first_at"),
        F.min_by(F.when(is_first, F.col("new_price_usd")), F.when(is_first, F.col("at"))).alias("first_price_usd"),
        F.count_if(kind == "price_changed").alias("price_change_count"),
        F.count_if(kind == "relisted").alias("relisted_count"),
        F.max(F.when(kind == "relisted", F.col("at"))).alias("last_relisted_at"),
        F.max(F.when(kind == "delisted", F.col("at"))).alias("last_delisted_at"),
    )
    first = F.col("first_price_usd")
    return current.join(agg, "listing_key", "left").select(
        "listing_key", F.coalesce("__first_at", "created_at").alias("first_seen_at"), "first_price_usd", "current_price_usd",
        F.when(first > 0, (F.col("current_price_usd") - first) / first * 100).alias("total_price_change_percent"),
        F.coalesce("price_change_count", F.lit(0)).alias("price_change_count"),
        F.coalesce("relisted_count", F.lit(0)).alias("relisted_count"), "last_relisted_at", "last_delisted_at")


def history_verdict(change: Column, relisted: Column) -> Column:
    """Relisted and cheaper, relisted, or falling price."""
    falling = F.coalesce(change <= -5, F.lit(False))
    return (F.when((relisted > 0) & falling, "ready_to_bargain").when(relisted > 0, "relisted")
            .when(falling, "price_falling"))


def price_verdict(diff: Column) -> Column:
    """Against the analogs' median, ten percent either way."""
    return F.when(diff <= -10, "good").when(diff >= 10, "expensive").when(diff.isNotNull(), "in_market")


def without_noise(events: DataFrame, threshold: float = 0.002) -> DataFrame:
    """Drop price changes that rise or fall by no more than ``threshold`` of the old price."""
    old, new = F.col("old_price_usd"), F.col("new_price_usd")
    noise = (F.col("event_type") == "price_changed") & (old > 0) & ((new >= old) | (old - new <= old * threshold))
    return events.where(~F.coalesce(noise, F.lit(False)))
