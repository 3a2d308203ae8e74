"""Small listing tables for the golden-value tests."""

from __future__ import annotations

import datetime as dt

LISTING = """id string, source string, source_id string, deal_type string, price_period string, status string, price double,
    currency string, price_usd double, area_m2 double, rooms int, price_per_m2_usd double, floor int, total_floors int,
    district string, building_key string, complex string, segment string, material string, micro_location string,
    year_built int, discount_percent double, commission_pct double, seller_id string, is_business boolean,
    seen_at timestamp_ntz, created_at timestamp_ntz, title string, description string, address_raw string, url string,
    photos array<string>, seller_type string, duplicate_group_key string, published_at timestamp_ntz,
    lat double, lng double, coords_precision string, is_furnished boolean"""

DEFAULTS = dict(
    source="board", deal_type="sale", status="active", currency="USD", area_m2=100.0, rooms=2, floor=5, total_floors=9,
    district="D", segment="secondary", is_business=False, seen_at=dt.datetime(2024, 1, 10), created_at=dt.datetime(2024, 1, 1),
    title="t", address_raw="a", url="u", photos=[])

NAMES = [part.split()[0] for part in LISTING.replace("\n", " ").split(",")]


def listings(spark, rows):
    """Rows as dicts; price per m2 follows from price and area, or the price from ppm."""
    full = []
    for i, r in enumerate(rows, 1):
        x = {**DEFAULTS, "id": str(i), "source_id": str(i), **r}
        if "ppm" in x:
            x["ppm"] = float(x["ppm"])
            x["price_usd"] = x["ppm"] * x["area_m2"]
            x["price_per_m2_usd"] = x.pop("ppm")
        x.setdefault("price_per_m2_usd", x["price_usd"] / x["area_m2"])
        x.setdefault("price", x["price_usd"])
        full.append(tuple(x.get(n) for n in NAMES))
    return spark.createDataFrame(full, LISTING)


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
