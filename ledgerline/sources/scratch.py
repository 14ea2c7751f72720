"""Intermediate tables several branches read, kept in the shared checkpoint folder.

A written table cuts lineage, survives lost executors, and lets each branch read only
the columns it needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import ensure_checkpoint_dir


_FOLDERS: dict[str, list[str]] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{label}")
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{label}")


def release(spark: SparkSession) -> int:
    """Delete the tables this application stored, once nothing reads them any more."""
    conf = spark._jsc.hadoopConfiguration()
    folders = _FOLDERS.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(folders)
