"""Loading of the parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``sf_dir/name.parquet``, a file or a folder of files, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
