"""Listing-style views of the driver tables, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2001-11-05"          # listings side
EVENTS_AS_OF = "2024-01-31"   # events side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PRICE = "(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE l_extendedprice * 0.005D END)"

_COLUMNS = [
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id",
    "o_orderpriority AS source",
    "CASE WHEN l_linestatus = 'F' THEN 'sale' ELSE 'rent' END AS deal_type",
    "CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'month' END AS price_period",
    "CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'active' END AS status",
    f"{_PRICE} AS price_usd",
    "l_quantity AS area_m2",
    f"{_PRICE} / l_quantity AS price_per_m2_usd",
    "l_linenumber AS rooms",
    "p_size AS floor",
    "50 AS total_floors",
    "n_name AS district",
    "concat(p_type, '/', n_name) AS building_key",
    "p_brand AS complex",
    "CASE WHEN p_retailprice >= 950 THEN 'new' ELSE 'secondary' END AS segment",
    "p_type AS material",
    "split(p_name, ' ')[0] AS micro_location",
    "CASE WHEN p_partkey % 4 <> 0 THEN CAST(1960 + p_partkey % 60 AS INT) END AS year_built",
    "l_discount * 100 + 0.0D AS discount_percent",
    "l_tax * 100 + 0.0D AS commission_pct",
    "o_custkey AS seller_id",
    "l_returnflag = 'R' AS is_business",
    "l_shipdate AS seen_at",
    "o_orderdate AS created_at",
    "p_name AS title",
    "l_returnflag AS description",
]


def listings(spark: SparkSession, sf_dir: str, *, by_status: bool = False) -> DataFrame:
    """One listing per lineitem, described by its part, supplier, nation and order.

    ``by_status`` joins orders first, for a caller that keeps one status: its filter then drops rows before the other joins.
    With all rows that order is the dearer one, since a part's rows pack well while they stand together.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders, parts = (table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")), (table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    first, last = (orders, parts) if by_status else (parts, orders)
    return (
        lines.join(*first)
        .join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(*last)
        .selectExpr(*_COLUMNS)
    )


_SQL_PRICE = "(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE l_extendedprice * 0.005 END)"

LISTINGS_SQL = f"""listings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    o_orderpriority AS source,
    CASE WHEN l_linestatus = 'F' THEN 'sale' ELSE 'rent' END AS deal_type,
    CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'month' END AS price_period,
    CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'active' END AS status,
    {_SQL_PRICE} AS price_usd, l_quantity AS area_m2, {_SQL_PRICE} / l_quantity AS price_per_m2_usd,
    l_linenumber AS rooms, p_size AS floor, 50 AS total_floors, n_name AS district,
    p_type || '/' || n_name AS building_key, p_brand AS complex,
    CASE WHEN p_retailprice >= 950 THEN 'new' ELSE 'secondary' END AS segment, p_type AS material,
    split_part(p_name, ' ', 1) AS micro_location,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(1960 + p_partkey % 60 AS INTEGER) END AS year_built,
    l_discount * 100 + 0.0 AS discount_percent, l_tax * 100 + 0.0 AS commission_pct,
    o_custkey AS seller_id, l_returnflag = 'R' AS is_business,
    l_shipdate AS seen_at, o_orderdate AS created_at, p_name AS title, l_returnflag AS description
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey),
sane AS (
  SELECT * FROM listings WHERE status = 'active'
    AND price_usd >= CASE WHEN deal_type = 'rent' THEN 50 ELSE 5000 END
    AND price_per_m2_usd >= CASE WHEN deal_type = 'rent' THEN 0.3 ELSE 100 END)"""


def with_listings(sql: str) -> str:
    return f"WITH {LISTINGS_SQL} {sql}"
