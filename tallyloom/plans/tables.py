"""The tables that the plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows of a small file that cost much work each, over four tasks a core: files are cut by their bytes, and a few megabytes are one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
