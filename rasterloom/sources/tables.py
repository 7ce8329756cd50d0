"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder as it is read; ``spread``: in parts enough for all cores, for work that is worth an exchange.

    A file with one row group is one part, however many cores wait; such a small table is dealt out anew. A table
    with as many parts as cores stays as it is read.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if not spread:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
