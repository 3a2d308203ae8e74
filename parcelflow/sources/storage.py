"""Materialised intermediates in the shared folder the cluster names.

Every application keeps its intermediates in one sub-folder of its own, which is removed when the
application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/parcelflow-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of recomputing the
    upstream joins, and gives the next joins a real size to choose a strategy by.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
