"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = 256 << 20


def size_in_bytes(df: DataFrame) -> int:
    """Size the optimiser expects a frame to have (file sizes, scaled by the columns read)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read_table(spark: SparkSession, path: str, spread: bool = True) -> DataFrame:
    """Parquet scan. A table of less than SMALL_BYTES (it may be a row group or two) is dealt
    out to all cores; anything larger is read as it is split on disk, however many cores there are."""
    df = spark.read.parquet(path)
    if not spread:
        return df
    if not 0 < size_in_bytes(df) < SMALL_BYTES:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)
