"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; where that is unset a local one, if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written once and read again: several plans use it, and its lineage ends."""
    return at(df, folder(df.sparkSession))


def at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, each query's shuffle files go when it has ended, not when the driver collects their handles."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
