"""Ingest cycles that leave one result however often they run.

A cycle writes its listings, events, delistings and runs into folders of its own and, last of all, one manifest row.
Readers take committed cycles only, so what a lost driver left half-written is not seen, and the next attempt
overwrites it.  A cycle that is committed is not run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.plans.state import ingest_cycle

PARTS = ["listings", "events", "delisted", "runs"]
START = 0


def committed(spark: SparkSession, out: str) -> list[int]:
    """The committed cycles in order; one small row each."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    rows = spark.read.schema("cycle int, as_of string").parquet(f"{out}/manifest").select("cycle").distinct()
    return sorted(r.cycle for r in rows.collect())


def _commit(spark: SparkSession, out: str, cycle: int, as_of: str | None, parts: dict[str, DataFrame]) -> None:
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}/cycle={cycle}")
    spark.createDataFrame([(as_of,)], "as_of string").coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/cycle={cycle}")


def begin(stored: DataFrame, out: str) -> None:
    """The listings before the first cycle; does nothing when they are there."""
    spark = stored.sparkSession
    if not committed(spark, out):
        _commit(spark, out, START, None, {"listings": stored})


def run_cycle(incoming: DataFrame, as_of: str, cycle: int, out: str) -> bool:
    """Run one cycle (1, 2, ...) on the listings of the last committed one; False when it is committed already."""
    spark = incoming.sparkSession
    done = committed(spark, out)
    if cycle in done:
        return False
    if not done or cycle < done[-1]:
        raise ValueError(f"cycle {cycle} cannot follow {done}")
    _commit(spark, out, cycle, as_of, ingest_cycle(current_listings(spark, out), incoming, as_of))
    return True


def current_listings(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/listings/cycle={committed(spark, out)[-1]}")


def log(spark: SparkSession, out: str, part: str) -> DataFrame:
    """Events, delistings or runs of all committed cycles, with their ``cycle``; needs one cycle at least."""
    paths = [f"{out}/{part}/cycle={c}" for c in committed(spark, out) if c != START]
    return spark.read.option("basePath", f"{out}/{part}").parquet(*paths)
