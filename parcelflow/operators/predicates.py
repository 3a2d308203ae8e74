"""Row predicates shared by search, statistics, valuation and alerts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelflow import constants as K


def by_deal(values: dict, deal: Column | None = None) -> Column:
    """Pick a per-deal-type constant; anything but rent follows the sale scale."""
    deal = F.col("deal_type") if deal is None else deal
    return F.when(deal == "rent", F.lit(values["rent"])).otherwise(F.lit(values["sale"]))


def plausible(price: str = "price_usd", ppm: str = "price_per_m2_usd") -> Column:
    """Price and price per m2 reach the floors of the row's deal type."""
    return (F.col(price) >= by_deal(K.PRICE_FLOOR)) & (F.col(ppm) >= by_deal(K.PPM_FLOOR))


def sane_active(deal_type: str | None = None) -> Column:
    """Active and plausible; with a deal type the floors become pushable constants."""
    if deal_type is None:
        return (F.col("status") == "active") & plausible()
    return (
        (F.col("status") == "active")
        & (F.col("deal_type") == deal_type)
        & (F.col("price_usd") >= K.PRICE_FLOOR[deal_type])
        & (F.col("price_per_m2_usd") >= K.PPM_FLOOR[deal_type])
    )


def sane_ppm(ppm: Column, deal: Column | None = None) -> Column:
    lo = by_deal({d: v[0] for d, v in K.SANE_PPM.items()}, deal)
    hi = by_deal({d: v[1] for d, v in K.SANE_PPM.items()}, deal)
    return ppm.between(lo, hi)


def extreme_floor(floor: str = "floor", total: str = "total_floors") -> Column:
    """First or last floor; an unknown floor counts as ordinary."""
    f, t = F.col(floor), F.col(total)
    return F.coalesce((f <= 1) | ((t >= 2) & (f >= t)), f <= 1, F.lit(False))


def price_drop(previous: Column, current: Column, threshold: float = K.PRICE_DROP_MIN) -> Column:
    """A fall strictly beyond the threshold; rises and unknown prices never count."""
    return F.coalesce(
        (previous > 0) & (current < previous) & (F.try_divide(previous - current, previous) > threshold),
        F.lit(False),
    )


def known_and(low: Column, high: Column, value: Column) -> Column:
    """Optional bounds: a NULL bound is open."""
    return (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))


def seller_filter(kind: str) -> Column:
    """Owner also accepts rows marked as free of commission."""
    exact = F.col("seller_type") == kind
    return exact | (F.col("commission_pct") == 0) if kind == "owner" else exact


def like_escaped(word: str) -> str:
    return "%" + word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_words(text: str, fields: list[str]) -> Column:
    """C4: every word occurs in at least one field, any case."""
    cond = F.lit(True)
    for word in text.replace(",", " ").split():
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.col(f).ilike(like_escaped(word)), F.lit(False))
        cond = cond & hit
    return cond


def excludes_words(text: str, fields: list[str]) -> Column:
    """No word occurs in any field; a missing field cannot contain a word."""
    cond = F.lit(True)
    for word in text.replace(",", " ").split():
        for f in fields:
            cond = cond & ~F.coalesce(F.col(f).ilike(like_escaped(word)), F.lit(False))
    return cond
