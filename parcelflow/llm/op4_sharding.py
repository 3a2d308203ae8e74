"""Sharding by a two-pass external shuffle.

Pass one scatters the whole records by a seeded hash into buckets of about ``bucket_rows`` records and ``BUCKET_BYTES`` bytes;
pass two orders each bucket by a seeded random key.  The buckets one after the other are a random
permutation of all records, which is cut into shards of equal counts (law ``rows``: at most one apart).

Buckets are sorted by Spark's external sort, which spills, so no bucket has to fit in memory and no record shares a row with
another.  A hash that more than ``bucket_rows`` records have is scattered anew by all columns and the record's place in
the input, so copies do not share one bucket; there are at most as many such hashes as buckets.  Without them the permutation depends
on the records, the seed and the number of buckets alone.

Records move once and are written to their shards from there.  Only one count a bucket is gathered, to know where each bucket starts.

Nulls and odd rows: a null text has no bytes; null ids are scattered by their other columns; rows that repeat
entirely each get a slot; groups of equal texts are spread at random; an empty table gives no rows; input columns named law, shard or slot give way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from parcelflow.llm.carry import carried
from parcelflow.llm.registry import query, table
from parcelflow.sources.storage import materialise, shared_dir

SHARDS = 40
BUCKET_ROWS = 8192
BUCKET_BYTES = 32 << 20
SEED = 20_240_607


def _bytes(records: DataFrame):
    """About how many bytes a record has."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in records.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum(sizes, F.lit(8 * len(records.columns))).cast("long")


def external_shuffle(records: DataFrame, *, shards: int = SHARDS, key: list[str] | None = None, bucket_rows: int = BUCKET_ROWS,
                     seed: int = SEED) -> DataFrame:
    """The records with law, shard and slot.  ``key`` names the columns that scatter them (default: all)."""
    columns = carried(records, None, ["law", "shard", "slot"])
    records = records.select(*columns)
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = records.select(_bytes(records).alias("n")).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    total = size["rows"]
    buckets = max(parts, -(-total // bucket_rows), -(-(size["bytes"] or 0) // BUCKET_BYTES))
    # records as one column, so that no name clashes
    hashed = records.select(F.xxhash64(F.lit(seed), *(key or columns)).alias("__hash"), F.xxhash64(F.lit(seed + 1), *columns).alias("__key"),
                            F.struct(*columns).alias("__record"))
    hot = materialise(hashed.groupBy("__hash").agg(F.count("*").alias("__n")).filter(F.col("__n") > bucket_rows).select("__hash", F.lit(True).alias("__hot")),
                      "repeated-hashes")
    place = F.xxhash64("__key", F.monotonically_increasing_id())
    salted = (hashed.withColumn("__place", place).join(hot, "__hash", "left")
              .withColumn("__spread", F.when(F.col("__hot"), F.col("__place")).otherwise(F.col("__hash"))))
    # pass one: scatter
    scattered = salted.select(F.pmod("__spread", F.lit(buckets)).alias("__bucket"),
                              F.when(F.col("__hot"), F.xxhash64("__place")).otherwise(F.col("__key")).alias("__key"), "__spread", "__record")
    # pass two: each bucket on its own
    mixed = scattered.withColumn("__at", F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", "__spread")) - 1)
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = (scattered.groupBy("__bucket").agg(F.count("*").alias("__n"))
              .select("__bucket", F.coalesce(before, F.lit(0)).alias("__start")))
    # rank r of n goes to shard ((r + 1) * shards - 1) div n, whose first rank is (shard * n) div shards
    ranked = mixed.join(materialise(starts, "bucket-starts"), "__bucket").select("__record", (F.col("__start") + F.col("__at")).alias("__rank"))
    dealt = ranked.withColumn("__shard", F.expr(f"((__rank + 1) * {shards} - 1) div {max(total, 1)}"))
    return dealt.select("__record.*", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"),
                        F.expr(f"__rank - (__shard * {total}) div {shards}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, the records of each of its files in slot order; a bucket's task writes its part of a shard."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = external_shuffle(table(spark, sf_dir, "documents"))
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(sharded, path)
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return spark.read.schema(sharded.schema).parquet(path).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "law", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
