"""Listing tables on disk and over JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_listings(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_listings(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Partitioned by deal type and status, sorted by what searches filter on, so files skip well."""
    (df.repartitionByRange("deal_type", "status", "district", "rooms", "id")
     .sortWithinPartitions("deal_type", "status", "district", "rooms")
     .write.mode(mode).partitionBy("deal_type", "status").parquet(path))


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str, low: int, high: int, parts: int,
              fetch: int = 10_000) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts,
                           properties={"fetchsize": str(fetch)})


def write_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "append", batch: int = 10_000) -> None:
    df.write.jdbc(url, table, mode=mode, properties={"batchsize": str(batch)})


def json_strings(text: Column) -> Column:
    """A JSON list of strings; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def write_catalogue(rows: DataFrame, path: str) -> None:
    """The URL catalogue as files; rendering it is left to whoever serves it."""
    rows.write.mode("overwrite").parquet(path)
