"""Exact grouped order statistics that never hold a whole group in one task.

``median``/``percentile`` keep a value->count map per group in one reducer, which a hot
group outgrows.  Here equal values are counted first (map-side combined), counts are
summed per order-preserving value band, a running sum over the few bands finds the band
that holds the wanted rank, and only that band's rows are ranked.  A hot group is spread
over its distinct values in step one and over its bands afterwards.

Trimming the same number of rows from both tails leaves the median where it was, so the
trimmed median of the market index is this median with a minimum group size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.operators.keys import join_on

BANDS_PER_OCTAVE = 16
_OFFSET = 20000  # larger than 16 * 1075, so negative and positive values never share a band


def value_band(value: Column, per_octave: int = BANDS_PER_OCTAVE) -> Column:
    """Order-preserving integer band of a double: bands grow with the value's magnitude."""
    magnitude = F.floor(F.log2(F.abs(value)) * per_octave) + _OFFSET
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * magnitude).cast("int")


def grouped_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    *,
    count_name: str = "n",
    min_count: int = 1,
) -> DataFrame:
    """Values at the given 1-based ranks per group, with the group's row count.

    ``ranks`` maps an output name to a function of the count column.
    """
    if not keys:
        return grouped_ranks(df.withColumn("__all", F.lit(1)), ["__all"], value, ranks,
                             count_name=count_name, min_count=min_count).drop("__all")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__b", value_band(F.col("__v")))
    )
    per_key = Window.partitionBy(*keys)
    bands = (
        counts.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
        .withColumn("__end", F.sum("__bc").over(per_key.orderBy("__b")))
        .withColumn("__n", F.sum("__bc").over(per_key))
        .where(F.col("__n") >= min_count)
    )
    wanted = {name: make(F.col("__n")).cast("long") for name, make in ranks.items()}
    holds = [(F.col("__end") >= r) & (F.col("__end") - F.col("__bc") < r) for r in wanted.values()]
    hit = holds[0]
    for h in holds[1:]:
        hit = hit | h
    target = bands.where(hit).select(*keys, "__b", "__n", (F.col("__end") - F.col("__bc")).alias("__before"))
    placed = (
        join_on(counts, target, [*keys, "__b"])
        .withColumn("__last", F.col("__before")
                    + F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__v")))
    )
    return placed.groupBy(*keys).agg(
        F.first("__n").alias(count_name),
        *[
            F.max(F.when((F.col("__last") >= r) & (F.col("__last") - F.col("__c") < r), F.col("__v"))).alias(name)
            for name, r in wanted.items()
        ],
    )


def grouped_median(df: DataFrame, keys: list[str], value: str, *, name: str = "median",
                   count_name: str = "n", min_count: int = 1) -> DataFrame:
    """Exact median per group: the middle value, or the mean of the two middle values."""
    out = grouped_ranks(
        df, keys, value,
        {"__lo": lambda n: F.floor((n + 1) / 2), "__hi": lambda n: F.floor(n / 2) + 1},
        count_name=count_name, min_count=min_count,
    )
    return out.withColumn(name, (F.col("__lo") + F.col("__hi")) / 2).drop("__lo", "__hi")


def grouped_medians(df: DataFrame, keys: list[str], values: list[str], *, min_count: int = 1,
                    count_name: str = "n") -> DataFrame:
    """Medians of several columns at once: the columns are stacked so one pass serves all."""
    stacked = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("x")) for v in values])).alias("s"),
    ).select(*keys, F.col("s.m").alias("__m"), F.col("s.x").alias("__x"))
    med = grouped_median(stacked, [*keys, "__m"], "__x", name="__med", min_count=min_count, count_name="__cnt")
    return med.groupBy(*keys).agg(
        F.max("__cnt").alias(count_name),
        *[F.max(F.when(F.col("__m") == v, F.col("__med"))).alias(f"median_{v}") for v in values],
    )


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """Rank of percentile ``p`` by rounding ``p * (n - 1)`` half to even, 1-based."""
    return lambda n: F.bround(F.lit(p) * (n - 1)) + 1
