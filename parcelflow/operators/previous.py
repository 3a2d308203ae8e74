"""Previous row per key without sorting a whole key in one task.

Rows are dealt by range of (key, order), so that a partition holds a share of all rows, whatever the keys: a key with most of the
rows is cut into as many stretches as it needs.  Inside a stretch a window looks one row back; the first row of a
stretch takes the last row of the key's stretch before it, found on one summary row per (key, stretch).
A caller that knows a column to cut by, such as the day, may give it instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.operators.keys import join_on
from parcelflow.sources.storage import materialise


def stretches(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``__bucket``, which rises along (keys, order); written once, so that bounds stay what they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *keys, *order).withColumn("__bucket", F.spark_partition_id()), "stretches")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: Column | None = None) -> DataFrame:
    """Add ``prev``, a struct of ``columns`` from the previous row by ``order``; NULL on the first.

    A ``bucket`` of the caller must not decrease along ``order``.
    """
    rows = stretches(df, keys, order) if bucket is None else df.withColumn("__bucket", bucket)
    row = F.struct(*columns)
    inside = rows.withColumn("prev", F.lag(row).over(Window.partitionBy(*keys, "__bucket").orderBy(*order)))
    last = rows.groupBy(*keys, "__bucket").agg(F.max_by(row, F.struct(*order)).alias("__last"))
    carried = last.withColumn(
        "__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket"))).drop("__last").where("__carry IS NOT NULL")
    return join_on(inside, carried, [*keys, "__bucket"], "left").withColumn(
        "prev", F.coalesce("prev", "__carry")).drop("__bucket", "__carry")


def last_known(df: DataFrame, keys: list[str], order: list[Column], value: str, bucket: Column, name: str) -> DataFrame:
    """Add ``name``: the latest non-NULL ``value`` of strictly earlier rows of the key.

    Pass descending expressions (negated numbers) in ``order`` and ``bucket`` to look ahead instead.
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__order", F.struct(*order))
    back = Window.partitionBy(*keys, "__bucket").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn(name, F.last(value, ignorenulls=True).over(back))
    last = rows.groupBy(*keys, "__bucket").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__order"))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("__carry", F.last("__last", ignorenulls=True).over(earlier)).drop("__last")
    return join_on(inside, carried, [*keys, "__bucket"], "left").withColumn(
        name, F.coalesce(name, "__carry")).drop("__bucket", "__order", "__carry")
